"""Runs, reports and command lines, files in and out, and how queries fail."""

from __future__ import annotations

import json
import os
import re
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylume import __main__ as cli
from querylume.functions import report_text
from querylume.functions import text as T
from querylume.functions.tokens import best_counter, file_counter
from querylume.operators import evaluation, execution
from querylume.operators.relational import not_in
from querylume.operators.storage import numbered
from querylume.plans import runs
from querylume.plans.evaluation import CASES
from querylume.plans.questions import EXAMPLES, QUESTIONS, star_examples, star_questions
from querylume.sources import catalog, files


def gold_answers(df):
    return df.withColumn("raw", F.when(F.col("q_id") != 4, F.concat(F.lit("```sql\n"), "sql", F.lit(";\n```"))))


@pytest.fixture(scope="module")
def folder(tmp_path_factory, small_dir):
    """A data folder in the benchmark's form over the test tables."""
    root = tmp_path_factory.mktemp("data")
    raw = []
    for db in catalog.DATABASES:
        rows = [r for r in catalog.declared_rows() if r[0] == db]
        at = {(r[3], r[4]): r[1] for r in rows}
        raw.append({
            "db_id": db, "table_names_original": list(catalog.DATABASES[db]), "column_names_original": [[r[2], r[4]] for r in rows], "column_types": [r[5] for r in rows],
            "primary_keys": [r[1] for r in rows if r[6]], "foreign_keys": [[r[1], at[r[7], r[8]]] for r in rows if r[7]],
        })
        (root / "database" / db).mkdir(parents=True)
        for table in catalog.DATABASES[db]:
            os.symlink(f"{small_dir}/{table}.parquet", root / "database" / db / f"{table}.parquet")
    (root / "tables.json").write_text(json.dumps(raw))
    asked = [q for q in QUESTIONS if q[3] != "SELECT 1"]
    (root / "dev.json").write_text(json.dumps([{"db_id": d, "question": q, "query": s} for _, d, q, s in asked]))
    (root / "train_spider.json").write_text(json.dumps([{"db_id": d, "question": q, "query": s} for _, d, q, s in EXAMPLES]))
    (root / "dev_gold").write_text("\n".join(f"{s}\t{d}" for _, d, _, s in asked) + "\n\n")
    return root


def test_pipeline_command(spark, folder, tmp_path, capsys):
    cli.main(["pipeline", "--data", str(folder), "--out", str(tmp_path), "--generator", "tests.test_runs:gold_answers", "--baseline", "--sweep-sample", "0.5"], spark)
    said = capsys.readouterr().out
    assert re.search(r"dev_gold.sql +NOT FOUND", said) and "ranked by F6" in said and "recommended: top_k_tables=" in said and "schema recall" in said
    assert said.count("execution accuracy") == 2 and said.count("partial match: f1") == 2
    lines = "".join(open(f).read() for f in files.part_files(f"{tmp_path}/graph_predictions")).splitlines()
    asked = [q for q in QUESTIONS if q[3] != "SELECT 1"]
    assert len(lines) == len(asked) and lines[4] == "SELECT 1" and lines[2] == asked[2][3]  # one failed, in order
    log = open(files.one_file(f"{tmp_path}/graph_log")).read()
    assert log.count("-" * 60) == len(asked) and "[1] DB: star" in log and "Recall : 0.0000" in log.split("[5] DB")[1]
    assert open(files.one_file(f"{tmp_path}/graph_results")).readline().strip() == "index,db_id,recall,precision"
    rows = spark.read.json(f"{tmp_path}/graph_prompts").collect()
    assert {r["i"] for r in rows} == set(range(1, len(asked) + 1)) and all(r["tokens_in"] > 0 for r in rows if r["i"] != 5)
    exact = next(x for x in said.splitlines() if x.startswith("exact ") and "match" not in x)
    assert float(exact.split()[-1]) == pytest.approx(10 / 11, abs=1e-3)


def test_other_commands(spark, folder, tmp_path, capsys):
    cli.main(["ablation", "--data", str(folder), "--out", str(tmp_path), "--generator", "tests.test_runs:gold_answers", "--sample", "1.0", "--k-values", "0", "2", "--run-eval", "--mode", "table"], spark)
    said = capsys.readouterr().out
    assert said.count("execution accuracy") == 2 and "consumption" in said
    rows = spark.read.csv(f"{tmp_path}/ablation_results", header=True, inferSchema=True).collect()
    assert [r["k"] for r in rows] == [0, 2] and rows[1]["avg_prompt_tokens"] > rows[0]["avg_prompt_tokens"]
    cli.main(["baseline", "--data", str(folder), "--out", str(tmp_path), "--sample", "0.5", "--compare"], spark)
    assert "table mode" in capsys.readouterr().out
    cli.main(["sweep", "--data", str(folder), "--out", str(tmp_path), "--sample", "0.3"], spark)
    assert "ranked by F1" in capsys.readouterr().out
    pred = tmp_path / "pred.txt"
    pred.write_text("\n".join(q[3] for q in QUESTIONS if q[3] != "SELECT 1"))
    cli.main(["evaluate", "--data", str(folder), "--gold", f"{folder}/dev_gold", "--pred", str(pred), "--etype", "match"], spark)
    said = capsys.readouterr().out
    assert "execution accuracy" not in said and next(x for x in said.splitlines() if x.startswith("exact ") and "match" not in x).split()[-1] == "1.000"


def test_a_sweep_point_is_a_run(spark):
    """The grid's filters on ranks give what a run with those numbers gives."""
    q, cat = star_questions(spark), catalog.declared(spark)
    points = {(r["top_k_tables"], r["top_k_columns"]): r for r in runs.sweep(q, cat, runs.Config()).collect()}
    assert len(points) == 15
    for kt, kc in ((1, 1), (2, 7), (3, 5)):
        one = runs.summary(runs.run(q, None, cat, replace(runs.Config(), top_k_tables=kt, top_k_columns=kc, few_shot=0))).first()
        assert all(one[c] == pytest.approx(points[kt, kc][c]) for c in ("avg_recall", "avg_precision", "f1", "f6"))


def test_full_schema_and_failures(spark):
    q, cat = star_questions(spark), catalog.declared(spark)
    out = runs.run(q, star_examples(spark), cat, runs.Config(full_schema=True, generate=gold_answers)).collect()
    assert len(out) == len(QUESTIONS)
    for r in out:
        if r["q_id"] == 4:  # no answer came
            assert (r["pred_sql"], r["recall"], r["precision"], r["tokens_in"], r["tokens_out"]) == ("SELECT 1", 0, 0, 0, 0)
        else:
            assert r["recall"] == 1 and r["pred_sql"] == QUESTIONS[r["q_id"]][3]


def test_scores_as_text(spark):
    from querylume.plans.evaluation import pairs

    scores = evaluation.evaluate(pairs(spark), catalog.declared(spark), "match")
    said = report_text.score_table(scores)
    assert said.splitlines()[2].split() == ["count", *(str(sum(c.level == x for c in CASES)) for x in ("easy", "medium", "hard", "extra")), str(len(CASES))]
    with pytest.raises(ValueError):
        evaluation.evaluate(pairs(spark), catalog.declared(spark), "both")


def test_errors_of_gold_queries_are_raised(spark):
    t = {"ge": ["id", "name"]}
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string").selectExpr("id", "name", "cast(name AS int) AS bad").createOrReplaceTempView("ge")
    t["ge"].append("bad")
    assert not execution.matches(spark, "SELECT id FROM ge", "SELECT bad FROM ge", t)  # another column
    assert not execution.matches(spark, "SELECT id FROM ge", "SELECT id FROM ge WHERE bad = 1", t)  # fails as it runs
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        execution.matches(spark, "SELECT id FROM ge WHERE bad = 1", "SELECT id FROM ge", t)
    rows = [(0, "d", "SELECT id FROM ge", "SELECT id FROM ge WHERE bad = 1"), (1, "d", "SELECT id FROM ge", "SELECT id FROM ge"), (2, "d", "SELECT id FROM ge ORDER BY id", "SELECT id FROM ge ORDER BY id"), (3, "d", "SELECT id FROM ge", "oops")]
    got = execution.match_all(spark.createDataFrame(rows, "idx long, db_id string, gold string, pred string"), lambda db: (t, {})).collect()
    assert {r["idx"]: r["exec"] for r in got} == {0: False, 1: True, 2: True, 3: False}
    with pytest.raises(ValueError):
        execution.matches(spark, "SELECT id FROM ge WHERE id IS NULL", "SELECT id FROM ge", t)


def test_texts_and_numbers_are_never_equal(spark):
    spark.createDataFrame([("1", 1)], "s string, n int").createOrReplaceTempView("tn")
    t = {"tn": ["s", "n"]}
    keys = {"__tn.s__": "__tn.n__"}
    assert not execution.matches(spark, "SELECT n FROM tn", "SELECT s FROM tn", t, keys)


def test_is_null_and_not_in_run(spark):
    spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, name string").createOrReplaceTempView("nn")
    t = {"nn": ["id", "name"]}
    ids = lambda sql: sorted(r[0] for r in execution.run_sql(spark, sql, t).collect())
    assert ids("SELECT id FROM nn WHERE name IS NULL") == [2] and ids("SELECT id FROM nn WHERE name IS NOT NULL") == [1, 3]
    assert ids("SELECT id FROM nn WHERE name NOT IN (SELECT name FROM nn WHERE id = 2)") == []
    a, none = spark.table("nn"), spark.table("nn").where("id > 9").select("name")
    assert not_in(a, "name", a.where("id = 2").select("name")).count() == 0
    assert [r["id"] for r in not_in(a, "name", a.where("id = 1").select("name")).collect()] == [3]
    assert not_in(a, "name", none).count() == 3


def test_lines_are_numbered_in_order(spark, tmp_path):
    lines = [f"line {i}" for i in range(5000)]
    (tmp_path / "x.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files.read_lines(spark, str(tmp_path / "x.txt"))
        assert [r["value"] for r in got.orderBy("line_no").collect()] == lines and got.agg(F.max("line_no")).first()[0] == 4999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbered(spark.range(0), "n").collect() == []


def test_samples_are_drawn_as_the_original_does():
    for n, ratio in ((10, 0.3), (1034, 0.2), (3, 0.01)):
        want = sorted(np.random.default_rng(42).choice(n, size=max(1, int(n * ratio)), replace=False).tolist())
        assert files.sample_indices(n, ratio) == want
    assert files.sample_indices(0, 0.5) == []


def test_small_things(spark, tmp_path):
    one = spark.createDataFrame([(2, 0.123456, " SELECT A ", "select a"), (1, 0.5, "x", "y")], "i int, r double, a string, b string")
    files.write_csv(one.select("i", "r"), str(tmp_path / "c"), {"r": 4}, ["i"])
    assert open(files.one_file(str(tmp_path / "c"))).read().splitlines() == ["i,r", "1,0.5", "2,0.1235"]
    files.write_jsonl(one.select("i"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert [r[0] for r in one.orderBy("i").select(T.same_sql(F.col("a"), F.col("b"))).collect()] == ["DIFF", "MATCH"]
    assert spark.range(1).select(T.without_database(F.lit("d.t.c"))).first()[0] == "t.c"
    assert spark.range(1).select(report_text.pretty(F.lit("has_group_by"))).first()[0] == "GROUP BY"
    assert files.gold_path(str(tmp_path)).endswith("dev_gold")
    (tmp_path / "dev_gold.sql").write_text("")
    assert files.gold_path(str(tmp_path)).endswith("dev_gold.sql")
    assert files.existing(str(tmp_path), ("dev_gold.sql", "nothing")) == {"dev_gold.sql": True, "nothing": False}
    (tmp_path / "t.json").write_text(json.dumps([{"table": "T", "col_data": [{"column_name": "A"}, {"column_name": "b"}]}]))
    assert [tuple(r) for r in catalog.read_table_catalog(spark, str(tmp_path / "t.json")).collect()] == [("t", 0, "a"), ("t", 1, "b")]
    one.createOrReplaceTempView("Small")
    assert [(r["table"], r["column"], r["type"]) for r in catalog.from_session(spark, ["Small"]).collect()][1:3] == [("small", "i", "int"), ("small", "r", "double")]


def test_token_counters(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    texts = ["SELECT a FROM t", "", None, "naïve café 日本"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    path = public.path("byte_bpe_50k.json")
    want = [len(tokenizers.Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    for p in (path, public.path("byte_bpe_50k.tiktoken")):
        assert [r[0] for r in df.orderBy("i").select(file_counter(p)(F.col("t"))).collect()] == want
    assert [r[0] for r in df.where("t is not null").orderBy("i").select(best_counter(None, "/nowhere")(F.col("t"))).collect()] == [4, 0, 3]


def brute_sums(rows, primes=execution._MODULI):
    return len(rows), *[sum(r[i] * pow(base, at, m) for at, r in enumerate(rows)) % m for i, (m, base) in enumerate(primes)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**31 - 20), st.integers(0, 2**31 - 20)), max_size=30), st.lists(st.integers(0, 30), max_size=5))
def test_folded_hash_ignores_the_bounds_of_parts(rows, cuts):
    edges = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    parts = [(k, *brute_sums(rows[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert execution.folded(reversed(parts)) == brute_sums(rows)


def test_ordered_results(spark):
    n = 40_000
    spark.range(n).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("x")).repartition(13).createOrReplaceTempView("ordered_rows")
    t = {"ordered_rows": ["id", "k", "x"]}
    same = lambda a, b: execution.matches(spark, a, b, t)
    gold = "SELECT id, x FROM ordered_rows ORDER BY id"
    assert same(gold, gold) and same(gold, "SELECT x, id FROM ordered_rows ORDER BY id")
    assert same(gold, f"SELECT id, x FROM ordered_rows ORDER BY id LIMIT {n}")  # parts with other bounds
    assert not same(gold, "SELECT id, x FROM ordered_rows ORDER BY id DESC")
    assert not same(gold, f"SELECT id, x FROM ordered_rows WHERE id < {n - 1} ORDER BY id")  # without the last row
    assert not same(gold, "SELECT x, k FROM ordered_rows ORDER BY id")
    sums = lambda df: execution.folded(map(tuple, execution.part_sums(df).select("part", "n", "h0", "h1").collect()))
    one = spark.range(1)
    a, b = (one.selectExpr(x, y) for x, y in (("null AS x", "1 AS y"), ("1 AS x", "null AS y")))
    assert sums(a) != sums(b) and sums(one.where("id > 0")) == (0, 0, 0)
    last = spark.range(n).select("id", "id")
    assert sums(last) != sums(spark.range(n).select("id", F.when(F.col("id") == n - 1, -1).otherwise(F.col("id")).alias("x")))


def test_pairs_of_a_large_database_are_dealt(spark):
    from querylume.plans.evaluation import CASES, pairs

    cat = catalog.declared(spark)
    many = pairs(spark)
    whole = sorted(map(tuple, evaluation.compare(many, cat).collect()))
    dealt = evaluation.with_schemas(many, cat, evaluation._compare, evaluation.PAIR_SCHEMA, group=5)
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) == 10 * len(CASES)
    with pytest.raises(Exception, match="the catalogue has no database"):
        evaluation.compare(many.withColumn("db_id", F.lit("unknown")), cat.where("db_id <> 'unknown'")).collect()
