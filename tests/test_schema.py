"""Catalogues, graphs, linking and text functions, by hand-made cases."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylume.functions import text as T
from querylume.functions.stats import p_value
from querylume.functions.vectors import top_k
from querylume.operators import graph, linking
from querylume.sources import catalog, files

RAW = [{
    "db_id": "d", "table_names_original": ["t", "u"], "table_names": ["tee", "you"],
    "column_names_original": [[-1, "*"], [0, "id"], [0, "k"], [0, "self"], [1, "id"], [1, "t_id"]], "column_names": [[-1, "*"], [0, "i d"], [0, "k"], [0, "self"], [1, "i d"], [1, "t id"]],
    "column_types": ["text", "number", "text", "number", "number", "number"], "primary_keys": [1, 2, 4], "foreign_keys": [[5, 4], [5, 1], [3, 1]],
}]


def test_catalogue_file(spark, tmp_path):
    path = tmp_path / "tables.json"
    path.write_text(json.dumps(RAW))
    rows = {r["col_idx"]: r for r in catalog.read_catalog(spark, str(path)).collect()}
    assert rows[0]["table"] == "ALL" and rows[0]["table_idx"] == -1
    assert (rows[5]["fk_table"], rows[5]["fk_column"]) == ("t", "id")  # the last pair of a column wins
    assert rows[2]["is_pk"] and not rows[3]["is_pk"]
    assert catalog.read_catalog(spark, str(path), original_names=False).where("col_idx = 5").first()["column"] == "t id"


def test_compatibility_view_round_trip(spark):
    view = catalog.compatibility_view(catalog.declared(spark))
    back = catalog.from_compatibility_view(view).where("fk_table is not null")
    assert back.count() == catalog.declared(spark).where("fk_table is not null").count()


def flat(spark):
    return catalog.flatten(spark.createDataFrame([tuple(RAW[0].get(f.name) if "names" not in f.name or "table" in f.name else [[str(a), b] for a, b in RAW[0][f.name]] for f in catalog.RAW)], catalog.RAW))


def test_column_graph_rules(spark):
    edges = {(r["u"], r["v"]): r["relation"] for r in graph.column_edges(flat(spark)).collect()}
    assert edges[("d.t.id", "d.t.k")] == "belongs_to_pk"  # the last primary key column is the anchor
    assert edges[("d.t.k", "d.t.self")] == "belongs_to_pk" and edges[("d.t.id", "d.t.self")] == "foreign_key"
    assert edges[("d.t.id", "d.u.t_id")] == "foreign_key" and ("d.u.id", "d.u.t_id") in edges


def test_paths_are_symmetric_and_smallest(spark):
    e = spark.createDataFrame([("d", *sorted(p)) for p in [("a", "b"), ("a", "c"), ("b", "z"), ("c", "z"), ("x", "y")]], "db_id string, u string, v string")
    got = {(r["src"], r["dst"]): r["path"] for r in graph.all_shortest_paths(e).collect()}
    assert got["a", "z"] == ["a", "b", "z"] and len(got["z", "a"]) == 3 and ("a", "x") not in got and got["x", "y"] == ["x", "y"]
    assert all(len(p) == len(got[d, s]) for (s, d), p in got.items())


def breadth_first(near, src):
    """The smallest shortest path to every node, level by level."""
    best, frontier = {src: [src]}, [src]
    while frontier:
        found = {}
        for v in frontier:
            for w in near[v]:
                if w not in best and (w not in found or best[v] + [w] < found[w]):
                    found[w] = best[v] + [w]
        best |= found
        frontier = list(found)
    return best


@pytest.mark.parametrize(("n", "extra", "seed"), [(60, 60, 1), (200, 20, 2), (5000, 400, 3)])
def test_labels_give_the_paths_of_a_search(n, extra, seed):
    rng = np.random.default_rng(seed)
    near = {f"n{i}": [] for i in range(n)}
    ends = [(i, int(rng.integers(max(0, i - 1 - i % 50), i))) for i in range(1, n) if i % 97] + [tuple(map(int, rng.integers(0, n, 2))) for _ in range(extra)]
    for a, b in {(min(e), max(e)) for e in ends if e[0] != e[1]}:
        near[f"n{a}"].append(f"n{b}")
        near[f"n{b}"].append(f"n{a}")
    own = graph.Routes(near, graph.labels_of(near))
    for src in rng.choice(list(near), min(n, 15), replace=False):
        want = breadth_first(near, src)
        for dst in near if n < 1000 else rng.choice(list(near), 300):
            assert own.path(src, dst) == want.get(dst)
    assert sum(map(len, own.labels.values())) < n * 60


def test_asked_paths_and_expanded_hits(spark, monkeypatch):
    pairs = [("a", "b"), ("a", "c"), ("b", "z"), ("c", "z"), ("x", "y"), ("z", "q"), ("q", "q")]
    e = spark.createDataFrame([(db, *sorted(p)) for db in ("d", "e") for p in pairs], "db_id string, u string, v string")
    known = graph.routes(e)
    whole = {(r["db_id"], r["src"], r["dst"]): (r["hops"], r["path"]) for r in graph.all_shortest_paths(e).collect()}
    asked = spark.createDataFrame([k for k in whole] + [("d", "a", "x"), ("d", "a", "a"), ("d", "gone", "a"), ("f", "a", "b")] + list(whole)[:5], "db_id string, src string, dst string")
    monkeypatch.setattr(graph, "GROUP", 3)
    got = {(r["db_id"], r["src"], r["dst"]): (r["hops"], r["path"]) for r in graph.paths_between(asked, known).collect()}
    assert got == whole and graph.paths_between(asked.limit(0), known).count() == 0
    hits = spark.createDataFrame([(1, "d", "a", 0), (1, "d", "q", 5), (1, "d", "x", 7), (2, "e", "y", 0), (3, "d", "q", 0), (3, "d", "a", 4), (4, "f", "lone", 0)], "q_id int, db_id string, node_id string, ord int")
    found = sorted((r["q_id"], r["node_id"], r["is_hit"]) for r in graph.expand_hits(hits, known).collect())
    assert found == [(1, "a", True), (1, "b", False), (1, "q", True), (1, "x", True), (1, "z", False), (2, "y", True), (3, "a", True), (3, "b", False), (3, "q", True), (3, "z", False), (4, "lone", True)]


def test_threshold_is_strict_and_zero_k_means_best_above_it(spark):
    at = lambda c: [c, (1 - c * c) ** 0.5]  # noqa: E731  a unit vector whose cosine with (1, 0) is c
    phrases = spark.createDataFrame([(1, "d", "p", [1.0, 0.0]), (1, "d", "q", [0.0, 1.0])], "q_id int, db_id string, phrase string, emb array<double>")
    elements = spark.createDataFrame([("d", "t", "a", 0, at(0.35)), ("d", "t", "b", 1, [0.0, 0.0]), ("d", "t", "c", 2, at(0.2))], "db_id string, table string, name string, ord int, emb array<double>")
    tables = spark.createDataFrame([(1, "t", 1)], "q_id int, name string, rank int")
    assert [r["name"] for r in linking.candidate_columns(phrases, elements, tables, 0).collect()] == ["c"]
    assert {r["name"] for r in linking.candidate_columns(phrases, elements, tables, 5).collect()} == {"a", "b", "c"}


def brute_nearest(phrases, elements, k, tables, cuts):
    out, unit = set(), lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    for q, db, phrase, own, emb in phrases:
        for cut in cuts:
            met = [(-round(float(unit(np.array(emb)) @ unit(np.array(e))), 9), ord_, name) for d, t, name, ord_, s, e in elements if d == db and s != own and tables.get((q, t), 99) <= cut]
            out |= {(cut, q, phrase, name, rank + 1) for rank, (_, _, name) in enumerate(sorted(met)[: k or None])}
    return out


def test_blocks_by_brute_force(spark, monkeypatch):
    """Many small groups give what all pairs give, whatever the blocks; ties go by ord."""
    rng = np.random.default_rng(7)
    vector = lambda: [float(x) for x in rng.integers(-2, 3, 3)]  # noqa: E731  few values, so many ties
    elements = [(db, f"t{i % 5}", f"{db}{i}", i, i, vector()) for db in "ab" for i in range(40)]
    phrases = [(q, "ab"[q % 2], f"p{i}", i, vector()) for q in range(9) for i in range(q * 4 % 17)]
    tables = {(q, f"t{(q + j) % 5}"): j + 1 for q in range(9) for j in range(3)}
    p = spark.createDataFrame(phrases, "q_id int, db_id string, phrase string, self int, emb array<double>")
    e = spark.createDataFrame(elements, "db_id string, table string, name string, ord int, self int, emb array<double>")
    t = spark.createDataFrame([(q, n, r) for (q, n), r in tables.items()], "q_id int, name string, rank int")
    everything = {(q, f"t{j}"): 1 for q in range(9) for j in range(5)}
    pooled = {}
    for q, db, _, own, emb in phrases:
        for d, name, _, _, s, x in elements:
            if d == db and s != own:
                a, b = np.array(emb), np.array(x)
                score = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9) if a.any() and b.any() else 0.0
                best = pooled.setdefault(q, {}).setdefault(name, [-9.0, int(name[1])])
                best[0] = max(best[0], score)
    for size in (10, 10_000):
        monkeypatch.setattr(linking, "PHRASES", size)
        monkeypatch.setattr(linking, "ELEMENTS", size)
        monkeypatch.setattr(linking, "SLICE", min(size, 7))
        for k, own, cuts in ((0, None, (1,)), (3, t, (1, 2, 3)), (1, t, (2,))):
            got = {(r["cut"], r["q_id"], r["phrase"], r["name"], r["rank"]) for r in linking.nearest(p, e, k, own, cuts).collect()}
            assert got == brute_nearest(phrases, elements, k, everything if own is None else tables, cuts)
        for k in (0, 2):
            got = {(r["q_id"], r["name"], round(r["score"], 6), r["rank"]) for r in linking.candidate_tables(p, e.select("db_id", F.col("table").alias("name"), F.substring("table", 2, 9).cast("int").alias("ord"), "self", "emb"), k).collect()}
            want = {(q, name, round(s, 6), i + 1) for q, found in pooled.items() for i, (name, (s, _)) in enumerate(sorted(found.items(), key=lambda x: (-x[1][0], x[1][1]))[: k or None])}
            assert got == want
    assert linking.nearest(p.limit(0), e, 3).count() == 0 and linking.candidate_tables(p, e.limit(0), 3).count() == 0


def test_same_group_first_reorders_the_pool_only(spark):
    pool = spark.createDataFrame([(1, 7, 100 + i, 7 if i in (3, 5) else 8, i) for i in range(1, 7)], "q_id long, q_grp long, id long, grp long, rank int")
    assert [r["id"] for r in linking.same_group_first(pool, 3).orderBy("place").collect()] == [103, 105, 101]


def test_top_k_of_more_than_there_are(spark):
    v = spark.createDataFrame([(i, 0, [float(i == j) for j in range(3)]) for i in range(3)], "id long, grp long, emb array<float>")
    got = top_k(v, v, 10).collect()
    assert len(got) == 6 and [r["id"] for r in got if r["q_id"] == 0] == [1, 2]


def test_phrases_and_gold_tokens(spark):
    row = spark.range(1).select(T.phrases(F.lit("Don't, stop É"), 2).alias("p"), T.phrases(F.lit("?!"), 3).alias("n"), T.gold_tokens(F.lit("SELECT T1.name, .x FROM a WHERE b='c'")).alias("g")).first()
    assert row["p"] == ["dont", "stop", "é", "dont stop", "stop é"] and row["n"] == [] and set(row["g"]) == {"t1.name", "x", "a", "b", "c"}


def test_cleaner(spark):
    cases = {
        "```sql\nSELECT T1.name FROM singer AS T1 WHERE T1.age > 20;\n```": "SELECT name FROM singer WHERE T1.age > 20", "": "SELECT 1", "no query": "no query",
        "SELECT a.x FROM a AS a JOIN b AS b ON a.id = b.id ORDER BY a.x NULLS LAST": "SELECT a.x FROM a AS a JOIN b AS b ON a.id = b.id ORDER BY a.x",
        "select n from t where n ilike 'x' and m::text = '1'": "select n FROM t where n LIKE 'x' and m = '1'", "SELECT joined FROM t AS x": "SELECT joined FROM t AS x",
    }
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.clean_sql(F.col("s")).alias("c")).collect()
    assert {r["s"]: r["c"] for r in got} == cases


def test_bar_rounds_half_to_even(spark):
    assert spark.range(1).select(T.bar(F.lit(0.125), 20).alias("b")).first()["b"].count("█") == 2


def test_scores_of_linking(spark):
    g = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["x"])], "q_id int, elements array<string>")
    r = spark.createDataFrame([(1, ["a", "c"]), (2, ["y"])], "q_id int, elements array<string>")
    assert {x["q_id"]: (x["recall"], x["precision"]) for x in linking.recall_precision(g, r).collect()} == {1: (0.5, 0.5), 2: (1.0, 1.0), 3: (0.0, 0.0)}


def test_p_value():
    assert abs(p_value(0.5, 20) - 0.024769) < 1e-4 and p_value(1.0, 5) == 0.0 and p_value(0.3, 2) == 1.0


def test_question_files(spark, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps([{"db_id": "d", "question": f"q{i}", "query": "SELECT 1"} for i in range(10)]))
    q = files.read_questions(spark, str(tmp_path / "dev.json"))
    assert [r["question"] for r in q.orderBy("idx").collect()] == [f"q{i}" for i in range(10)]
    assert files.found_column(q, files.SQL_NAMES) == "query" and files.sample(q, 0.3).count() == 3
    files.write_lines(q, str(tmp_path / "out"), "question")
    assert [r["value"] for r in files.read_lines(spark, str(tmp_path / "out" / "part-*.txt")).orderBy("line_no").collect()][:2] == ["q0", "q1"]


def test_end_to_end(spark):
    from querylume.plans import questions, runs

    out = runs.run(questions.star_questions(spark), questions.star_examples(spark), catalog.declared(spark), runs.Config(generate=lambda df: df.withColumn("raw", F.col("sql")))).collect()
    assert len(out) == len(questions.QUESTIONS) and all("CREATE TABLE" in r["prompt"] and "### Examples" in r["prompt"] and 0 <= r["recall"] <= 1 for r in out)
    assert next(r for r in out if r["q_id"] == 2)["pred_sql"] == "SELECT p_brand, p_size FROM part ORDER BY p_retailprice"


def test_entry_module_stands_without_the_optional_part(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("querylume.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("querylume.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    import querylume

    monkeypatch.delattr(querylume, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and len(entry.queries()) >= 80 and not any(k.startswith("op") and k[2].isdigit() for k in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_groups_of_all_pairs_are_small(spark):
    from pyspark.sql import functions as F

    import pyarrow as pa

    e = spark.range(6000).select(F.lit("d").alias("db_id"), F.lit("t").alias("table"), F.col("id").alias("name"), F.col("id").alias("ord"), F.array(F.lit(1.0), F.rand(1)).alias("emb"))
    p = e.where("ord < 900").select("db_id", F.lit(0).alias("q_id"), F.col("ord").alias("phrase"), "emb")
    kernel = lambda part, others, scores: pa.table({"n": pa.array([scores.size], pa.int64())})
    sizes = [r["n"] for r in linking._meet(p, e, kernel, "n long", everything=True).collect()]
    assert sum(sizes) == 6000 * 900 and max(sizes) < 2 * linking.ALL_PHRASES * linking.ALL_ELEMENTS
    assert linking.nearest(p, e, 0).count() == 6000 * 900
