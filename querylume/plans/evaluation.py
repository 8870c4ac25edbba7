"""Parsing, comparing, running and scoring SQL over the star schema.

CASES has pairs of gold and predicted SQL with what they are known to give, derived by hand from the rules of the
benchmark: the SQL of these queries is that table, so that a change of the parser or the comparison shows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import functions as F

from querylume.functions import sqlcompare as C
from querylume.operators import evaluation, execution
from querylume.sources import catalog
from querylume.sources.tables import STAR, register_views

QUERIES, ORACLE = {}, {}


class Case(NamedTuple):
    """A pair, and by hand: the tables of the gold query's FROM; its clauses, nested queries and other marks; its level;
    whether the match is exact; whether the results are equal; and for the ten parts of PARTS the totals of gold and
    prediction and the score, a digit each (an empty text: the prediction's are the gold's, or all scores are 1)."""

    gold: str
    pred: str
    tables: str
    counts: str
    level: str
    exact: int
    exec: int
    gold_totals: str
    pred_totals: str = ""
    scores: str = ""


_JOINED = "FROM nation AS T1 JOIN region AS T2 ON T1.n_regionkey = T2.r_regionkey"
_BUYERS = "FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE T2.o_totalprice > 1000 AND T2.o_orderstatus = 'O'"
_LATE = "FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 100000 GROUP BY o_custkey HAVING count(*) >"
CASES = [
    # values, their order and the order of conditions don't count; the results differ
    Case("SELECT c_name FROM customer WHERE c_acctbal > 9000", "SELECT c_name FROM customer WHERE c_acctbal > 100", "customer", "100", "easy", 1, 0, "1111000101"),
    Case("SELECT c_name FROM customer WHERE c_acctbal > 9000 AND c_nationkey = 3", "SELECT c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 9000", "customer", "101", "medium", 1, 1, "1122000101"),
    Case("SELECT count(*), o_orderstatus FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", "orders", "101", "medium", 1, 1, "2200110101"),
    # another operator: only the part without operators matches, and LIKE is a word of its own
    Case(f"SELECT T1.n_name {_JOINED} WHERE T2.r_name LIKE 'asia'", f"SELECT T1.n_name {_JOINED} WHERE T2.r_name = 'ASIA'", "nation region", "300", "hard", 0, 1, "1111000102", "1111000101", "1101111110"),
    Case("SELECT p_brand FROM part ORDER BY p_size DESC LIMIT 3", "SELECT p_brand FROM part ORDER BY p_size ASC LIMIT 5", "part", "200", "medium", 0, 0, "1100001103", "", "1111110110"),
    # the nested query's values don't count either; NOT counts as an aggregate, but one alone is no mark
    Case("SELECT s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 10)", "SELECT s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 20)", "supplier", "110", "hard", 1, 1, "1111000103"),
    # both columns stand for the nation's key in the outer queries, but the operands use the outer query's columns
    Case("SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer", "customer", "010", "hard", 0, 1, "1100000111", "", "1111111101"),
    # every part matches, but not the tables
    Case("SELECT n_regionkey FROM nation", "SELECT r_regionkey FROM region", "nation", "000", "easy", 0, 0, "1100000100"),
    # both units are one key, of which the last counts
    Case("SELECT max(p_size), min(p_size) FROM part", "SELECT min(p_size), max(p_size) FROM part", "part", "002", "medium", 1, 0, "2200000100"),
    # predictions that don't parse are empty queries
    Case("SELECT r_name FROM region", "SELEC r_name FROM", "region", "000", "easy", 0, 0, "1100000100", "0000000100", "0011111111"),
    Case("SELECT n_name FROM nation", "", "nation", "000", "easy", 0, 0, "1100000100", "0000000100", "0011111111"),
    Case(f"SELECT avg(o_totalprice) {_LATE} 3 ORDER BY count(*)", f"SELECT avg(o_totalprice) {_LATE} 5 ORDER BY count(*)", "orders", "402", "extra", 1, 0, "1122111106"),
    # BETWEEN is one test, two comparisons are two and a connective; its totals stand the other way round
    Case("SELECT p_name FROM part WHERE p_size BETWEEN 5 AND 15", "SELECT p_name FROM part WHERE p_size >= 5 AND p_size <= 15", "part", "100", "easy", 0, 1, "1111000101", "1122000001", "1100111011"),
    Case("SELECT c_name FROM customer WHERE c_nationkey = 3 OR c_acctbal > 500", "SELECT c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 500", "customer", "201", "medium", 0, 0, "1122000102", "1122000101", "1111111010"),
    # DISTINCT doesn't count, in SELECT or in an aggregate
    Case("SELECT DISTINCT o_orderpriority FROM orders", "SELECT o_orderpriority FROM orders", "orders", "000", "easy", 1, 0, "1100000100"),
    Case("SELECT count(DISTINCT c_nationkey) FROM customer", "SELECT count(c_nationkey) FROM customer", "customer", "000", "easy", 1, 0, "1100000100"),
    # clauses that one side lacks
    Case("SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) FROM orders", "orders", "101", "medium", 0, 0, "2200110101", "2200000100", "1111001110"),
    Case("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING count(*) > 1", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment", "customer", "100", "easy", 0, 1, "1100110102", "1100110101", "1111101110"),
    Case("SELECT p_brand FROM part GROUP BY p_brand", "SELECT p_brand FROM part GROUP BY p_brand, p_size", "part", "100", "easy", 0, 0, "1100110101", "1100210101", "1111001111"),
    Case("SELECT c_name FROM customer ORDER BY c_acctbal", "SELECT c_name FROM customer ORDER BY c_acctbal LIMIT 3", "customer", "100", "easy", 0, 0, "1100001102", "1100001103", "1111110110"),
    # that there is a limit counts, its value doesn't
    Case("SELECT p_name FROM part ORDER BY p_partkey LIMIT 3", "SELECT p_name FROM part ORDER BY p_partkey LIMIT 5", "part", "200", "medium", 1, 0, "1100001103"),
    Case("SELECT p_name FROM part ORDER BY p_partkey ASC", "SELECT p_name FROM part ORDER BY p_partkey", "part", "100", "easy", 1, 1, "1100001102"),
    Case("SELECT c_name FROM customer ORDER BY c_nationkey, c_custkey", "SELECT c_name FROM customer ORDER BY c_custkey, c_nationkey", "customer", "100", "easy", 0, 0, "1100001102", "", "1111110111"),
    # set operators
    Case("SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer", "SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer", "nation", "010", "hard", 0, 0, "1100000111", "", "1111111100"),
    Case("SELECT c_custkey FROM customer WHERE c_acctbal > 100 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 5", "customer", "110", "hard", 1, 0, "1111000112"),
    Case("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)", "part", "010", "hard", 0, 1, "1100000111", "1111000103", "1100111100"),
    Case("SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) UNION SELECT c_name FROM customer", "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) UNION SELECT c_name FROM customer WHERE c_custkey >= 0", "supplier", "120", "extra", 0, 1, "1111000113", "", "1111111101"),
    # another aggregate: only the part without aggregates matches
    Case("SELECT sum(o_totalprice) FROM orders", "SELECT avg(o_totalprice) FROM orders", "orders", "000", "easy", 0, 0, "1100000100", "", "0111111111"),
    # tables in any order; join conditions don't count
    Case(f"SELECT T2.r_name {_JOINED} WHERE T1.n_nationkey = 3", "SELECT T1.r_name FROM region AS T1 JOIN nation AS T2 ON T2.n_regionkey = T1.r_regionkey WHERE T2.n_nationkey = 3", "nation region", "200", "medium", 1, 1, "1111000101"),
    Case(f"SELECT T1.n_name {_JOINED}", "SELECT T1.n_name FROM nation AS T1 JOIN region AS T2", "nation region", "100", "easy", 1, 0, "1100000100"),
    # nested queries
    Case("SELECT c_name FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", "SELECT c_name FROM customer WHERE c_acctbal > (SELECT max(c_acctbal) FROM customer)", "customer", "110", "hard", 0, 0, "1111000101", "", "1101111111"),
    Case("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 2)", "orders", "110", "hard", 1, 0, "1111000102"),
    Case("SELECT p_name FROM part WHERE p_type NOT LIKE '%a%'", "SELECT p_name FROM part WHERE p_type LIKE '%a%'", "part", "200", "medium", 0, 0, "1111000103", "1111000102", "1101111110"),
    Case("SELECT l_extendedprice * l_discount FROM lineitem WHERE l_linenumber = 1", "SELECT l_discount * l_extendedprice FROM lineitem WHERE l_linenumber = 1", "lineitem", "100", "easy", 0, 0, "1111000101", "", "0011111111"),
    Case("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC LIMIT 1", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) ASC LIMIT 1", "orders", "300", "hard", 0, 0, "1100111104", "", "1111110110"),
    # columns of a foreign key stand for each other where both tables are named
    Case(f"SELECT T1.c_name, count(*) {_BUYERS} GROUP BY T1.c_custkey ORDER BY T1.c_custkey", f"SELECT T1.c_name, count(*) {_BUYERS} GROUP BY T2.o_custkey ORDER BY T2.o_custkey", "customer orders", "402", "extra", 1, 1, "2222111104"),
    Case("SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)", "SELECT count(DISTINCT o_custkey) FROM orders", "(query)", "000", "easy", 0, 0, "1100000100", "", "0011111111"),
    Case("SELECT s_name FROM supplier WHERE s_nationkey >= 0", "SELECT s_name FROM supplier WHERE s_acctbal > 99999999", "supplier", "100", "easy", 0, 0, "1111000101", "", "1100111111"),
    Case("SELECT c_name FROM customer", "SELECT c_name, c_acctbal FROM customer", "customer", "000", "easy", 0, 0, "1100000100", "2200000100", "0011111111"),
    Case("SELECT r_name FROM region WHERE r_regionkey = 1", "SELECT r_name FROM region WHERE r_regionkey IN (1)", "region", "100", "easy", 0, 1, "1111000101", "1111000102", "1101111110"),
    Case("SELECT p_brand FROM part WHERE p_size > 10 GROUP BY p_brand HAVING count(*) > 0 ORDER BY p_brand", "select  p_brand from PART where p_size>10 group by p_brand having count ( * ) > 0 order by p_brand asc ;", "part", "300", "hard", 1, 1, "1111111105"),
    # boundaries of the levels: three other marks; two clauses and two marks, which no rule but the last takes
    Case("SELECT max(p_size), min(p_retailprice) FROM part WHERE p_size > 3 AND p_retailprice > 1", "SELECT min(p_retailprice), max(p_size) FROM part WHERE p_retailprice > 1 AND p_size > 3", "part", "103", "hard", 1, 1, "2222000101"),
    Case("SELECT count(*), c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_nationkey < 50 GROUP BY c_mktsegment", "SELECT count(*), c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_nationkey < 50 GROUP BY c_mktsegment", "customer", "202", "extra", 1, 1, "2222110102"),
    Case("SELECT T3.r_name FROM customer AS T1 JOIN nation AS T2 ON T1.c_nationkey = T2.n_nationkey JOIN region AS T3 ON T2.n_regionkey = T3.r_regionkey WHERE T1.c_custkey = 99999999", f"SELECT T2.r_name {_JOINED} WHERE T1.n_nationkey = 99999999", "customer nation region", "300", "hard", 0, 1, "1111000101", "", "1100111111"),
]


def _keep(f):
    QUERIES[f.__name__] = f
    return f


def pairs(spark):
    return spark.createDataFrame([(i, "star", c.gold, c.pred) for i, c in enumerate(CASES)], "idx long, db_id string, gold string, pred string")


def _parts(spark, d):
    return evaluation.compare(pairs(spark), catalog.of_tables(spark, d))


def executed(spark, d):
    """The pairs' execution match over the tables in ``d``."""

    def run(found):
        register_views(spark, d, STAR)
        return execution.match_all(found, evaluation.schemas_in(catalog.of_tables(spark, d)))

    return run


def _literal(names: str, rows: list[tuple], big: tuple[str, ...] = ("idx",)) -> str:
    """The rows as a common table expression v; the columns ``big`` are BIGINT."""
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    kinds = ["::BIGINT" if n in big else "" for n in names.split(", ")]
    return f"v({names}) AS (VALUES " + ", ".join("(" + ", ".join(show(x) + k for x, k in zip(r, kinds)) + ")" for r in rows) + ")"


_PARSES = [c.pred != "" and not c.pred.startswith("SELEC ") for c in CASES]

@_keep
def sql_parse(spark, d):
    """What the parser finds in the gold queries."""
    rows = evaluation.parse_all(pairs(spark).withColumnRenamed("gold", "sql"), catalog.of_tables(spark, d))
    tree = F.from_json("ast", "select array<string>, tables array<string>, where struct<tests: array<string>>, `group` array<string>")
    name = lambda t: F.when(F.startswith(t, F.lit("{")), "(query)").otherwise(F.regexp_replace(t, "^__|__$", ""))
    out = rows.select("idx", tree.alias("t"))
    return out.select("idx", F.array_join(F.transform("t.tables", name), " ").alias("tables"), F.size("t.select").alias("n_select"), F.size("t.where.tests").alias("n_tests"), F.size("t.group").alias("n_group"))


_facts = [(i, c.tables, int(c.gold_totals[0]), int(c.gold_totals[2]), int(c.gold_totals[4])) for i, c in enumerate(CASES)]
ORACLE["sql_parse"] = f"WITH {_literal('idx, tables, n_select, n_tests, n_group', _facts)} SELECT * FROM v"


@_keep
def sql_hardness(spark, d):
    return evaluation.parse_all(pairs(spark).withColumnRenamed("gold", "sql"), catalog.of_tables(spark, d)).select("idx", "level", "clauses", "below", "others")


ORACLE["sql_hardness"] = f"WITH {_literal('idx, level, clauses, below, others', [(i, c.level, *map(int, c.counts)) for i, c in enumerate(CASES)], ('idx', 'clauses', 'below', 'others'))} SELECT * FROM v"


@_keep
def partial_match(spark, d):
    return _parts(spark, d)


_part_rows = [
    (i, "star", c.level, _PARSES[i], bool(c.exact), part, int(c.gold_totals[k]), int((c.pred_totals or c.gold_totals)[k]), int((c.scores or "1" * 10)[k]))
    for i, c in enumerate(CASES) for k, part in enumerate(C.PARTS)
]
_PART_SQL = f"WITH {_literal('idx, db_id, level, parsed, exact, part, gold_total, pred_total, score', _part_rows)}"
ORACLE["partial_match"] = _PART_SQL + " SELECT * FROM v"


@_keep
def exact_match(spark, d):
    return _parts(spark, d).select("idx", "level", "parsed", "exact").distinct()


_pair_rows = [(i, c.level, _PARSES[i], bool(c.exact), c.exec == 1) for i, c in enumerate(CASES)]
_PAIR_SQL = f"WITH {_literal('idx, level, parsed, exact, exec', _pair_rows)}"
ORACLE["exact_match"] = _PAIR_SQL + " SELECT idx, level, parsed, exact FROM v"


@_keep
def exact_by_level(spark, d):
    return evaluation.exact_by_level(_parts(spark, d))


ORACLE["exact_by_level"] = _PAIR_SQL + " SELECT coalesce(level, 'all') AS level, count(*) AS count, round(avg(exact::INT), 6) AS exact FROM v GROUP BY GROUPING SETS ((level), ())"


@_keep
def exec_match(spark, d):
    return executed(spark, d)(pairs(spark))


ORACLE["exec_match"] = _PAIR_SQL + " SELECT idx, exec FROM v"


_LINES = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"
#: Ordered pairs over the largest table, and each side's rows and order for the SQL.
ORDERED = [
    (f"{_LINES} ORDER BY l_orderkey, l_linenumber", f"{_LINES} ORDER BY l_orderkey, l_linenumber"),
    (f"{_LINES} ORDER BY l_orderkey, l_linenumber", "SELECT l_quantity, l_linenumber, l_orderkey FROM lineitem ORDER BY l_orderkey, l_linenumber"),
    (f"{_LINES} ORDER BY l_orderkey, l_linenumber", f"{_LINES} WHERE l_orderkey < (SELECT max(o_orderkey) FROM orders) ORDER BY l_orderkey, l_linenumber"),  # but the last order's
    (f"{_LINES} ORDER BY l_orderkey, l_linenumber", f"{_LINES} ORDER BY l_orderkey DESC, l_linenumber"),
    (f"{_LINES} ORDER BY l_orderkey DESC, l_linenumber DESC", f"{_LINES} WHERE l_quantity > 0 ORDER BY l_orderkey DESC, l_linenumber DESC"),
]


@_keep
def ordered_exec_match(spark, d):
    """Execution match of ordered results with as many rows as lineitem has."""
    found = spark.createDataFrame([(i, "star", g, p) for i, (g, p) in enumerate(ORDERED)], "idx long, db_id string, gold string, pred string")
    return executed(spark, d)(found)


def _rows_in_order(sql: str) -> str:
    body, order = sql.split(" FROM ", 1)[1].split(" ORDER BY ")
    return f"(SELECT list((l_orderkey, l_linenumber, l_quantity) ORDER BY {order}) FROM {body})"


ORACLE["ordered_exec_match"] = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS idx, {_rows_in_order(g)} = {_rows_in_order(p)} AS exec" for i, (g, p) in enumerate(ORDERED))


@_keep
def score_rollup(spark, d):
    return evaluation.rollup_scores(_parts(spark, d))


_ROLLUP = """a AS (SELECT coalesce(level, 'all') AS level, part, coalesce(avg(score) FILTER (WHERE pred_total > 0), 0) AS acc, coalesce(avg(score) FILTER (WHERE gold_total > 0), 0) AS rec, count(*) AS count
FROM v GROUP BY GROUPING SETS ((level, part), (part))),
r AS (SELECT level, part, round(acc, 6) AS accuracy, round(rec, 6) AS recall, round(CASE WHEN acc = 0 AND rec = 0 THEN 1 ELSE 2 * acc * rec / (acc + rec) END, 6) AS f1, count FROM a)"""
ORACLE["score_rollup"] = f"{_PART_SQL}, {_ROLLUP} SELECT * FROM r"


@_keep
def evaluate(spark, d):
    """The whole evaluator: counts, execution accuracy, exact and partial matches, by level."""
    return evaluation.evaluate(pairs(spark), catalog.of_tables(spark, d), "all", executed(spark, d))


ORACLE["evaluate"] = f"""{_PART_SQL}, {_ROLLUP}, {_PAIR_SQL[5:].replace('v(', 'pairs(', 1)},
c AS (SELECT coalesce(level, 'all') AS level, count(*) AS count, round(avg(exec::INT), 6) AS exec, round(avg(exact::INT), 6) AS exact FROM pairs GROUP BY GROUPING SETS ((level), ()))
SELECT level, 'count' AS metric, '' AS part, count::DOUBLE AS value FROM c UNION ALL SELECT level, 'exec', '', exec FROM c UNION ALL SELECT level, 'exact', '', exact FROM c
UNION ALL SELECT level, 'accuracy', part, accuracy FROM r UNION ALL SELECT level, 'recall', part, recall FROM r UNION ALL SELECT level, 'f1', part, f1 FROM r"""


@_keep
def hardness_dist(spark, d):
    """Gold queries by level, all four levels in their order, those without a query with 0."""
    levels = spark.createDataFrame(list(enumerate(C.LEVELS)), "place int, level string")
    found = evaluation.parse_all(pairs(spark).withColumnRenamed("gold", "sql"), catalog.of_tables(spark, d)).groupBy("level").agg(F.count("*").alias("n"))
    return levels.join(found, "level", "left").select("place", "level", F.coalesce("n", F.lit(0)).alias("n"))


ORACLE["hardness_dist"] = f"{_PAIR_SQL}, {_literal('place, level', list(enumerate(C.LEVELS))).replace('v(', 'levels(', 1)} SELECT place, levels.level, count(v.idx) AS n FROM levels LEFT JOIN v USING (level) GROUP BY 1, 2"
