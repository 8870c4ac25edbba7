"""The relational operators of the accepted SQL subset, as DataFrame queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylume.operators.relational import not_in
from querylume.sources.tables import table

QUERIES, ORACLE = {}, {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


@_query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@_query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_select(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@_query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 15 AND p_type ILIKE '%e%' AND p_brand IN (SELECT p_brand FROM part WHERE p_size = 1)")
def between_like_in(spark, d):
    part = table(spark, d, "part")
    brands = part.where("p_size = 1").select("p_brand").distinct()
    return part.where(F.col("p_size").between(5, 15) & F.col("p_type").ilike("%e%")).join(brands, "p_brand", "left_semi").select("p_partkey", "p_name", "p_size")


@_query("SELECT p_partkey FROM part WHERE p_type NOT ILIKE '%S%'")
def not_like(spark, d):
    return table(spark, d, "part").where(~F.col("p_type").ilike("%S%")).select("p_partkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def not_in_subquery(spark, d):
    rich = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey")
    return not_in(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", rich)


_MAYBE = "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer"


@_query(f"WITH c AS ({_MAYBE}) SELECT c_custkey, coalesce(k, -1) AS k FROM c WHERE k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def not_in_with_null_left(spark, d):
    """A null is neither in a list nor not in it."""
    left = table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return not_in(left, "k", table(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey")).select("c_custkey", F.coalesce("k", F.lit(-1)).alias("k"))


@_query(f"SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT k FROM ({_MAYBE}))")
def not_in_with_null_right(spark, d):
    """Nothing is not in a list with a null."""
    right = table(spark, d, "customer").select(F.nullif("c_nationkey", F.lit(3)))
    return not_in(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", right).select("s_suppkey")


@_query("SELECT p_partkey, p_brand FROM part WHERE nullif(p_size, 7) IS NULL")
def is_null(spark, d):
    return table(spark, d, "part").where(F.nullif("p_size", F.lit(7)).isNull()).select("p_partkey", "p_brand")


@_query("SELECT p_brand, count(*) AS n FROM part WHERE nullif(p_size, 7) IS NOT NULL GROUP BY p_brand")
def is_not_null(spark, d):
    return table(spark, d, "part").where(F.nullif("p_size", F.lit(7)).isNotNull()).groupBy("p_brand").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    mean = orders.agg(F.avg("o_totalprice").alias("m"))
    return orders.crossJoin(F.broadcast(mean)).where("o_totalprice > m").drop("m")  # one row


@_query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 49)")
def exists_subquery(spark, d):
    large = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(large, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@_query("SELECT p_partkey, p_retailprice + p_size AS added, p_retailprice - p_size AS taken, p_retailprice * p_size AS times, p_retailprice / nullif(p_size - 1, 0) AS per, CAST(p_partkey // p_size AS BIGINT) AS whole FROM part")
def arith_units(spark, d):
    p, s = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", (p + s).alias("added"), (p - s).alias("taken"), (p * s).alias("times"), F.try_divide(p, s - 1).alias("per"), F.expr("p_partkey div p_size").alias("whole"))


@_query("SELECT c, n FROM (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey) AS per_customer WHERE n > 12")
def derived_table(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("n")).where("n > 12")


@_query("SELECT s_suppkey, n_name FROM supplier AS t1 JOIN nation AS t2 ON t1.s_nationkey = t2.n_nationkey")
def join_two(spark, d):
    s, n = table(spark, d, "supplier").alias("t1"), table(spark, d, "nation").alias("t2")
    return s.join(n, F.col("t1.s_nationkey") == F.col("t2.n_nationkey")).select("s_suppkey", "n_name")


@_query("""SELECT r_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_returnflag = 'N' GROUP BY r_name""")
def join_chain(spark, d):
    line = table(spark, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    cust = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    # lines are summed per order before they meet the customers
    per = line.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    met = per.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return met.groupBy("r_name").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("revenue"))


@_query("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("low"), F.col("b.n_name").alias("high"))


@_query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 10 AND avg(c_acctbal) > 1000")
def group_having(spark, d):
    out = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"))
    return out.where("n > 10 and m > 1000").drop("m")


@_query("SELECT l_returnflag, max(l_tax) AS hi, min(l_tax) AS lo, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_all_five(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max("l_tax").alias("hi"), F.min("l_tax").alias("lo"), F.count("*").alias("n"), F.sum("l_linenumber").alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@_query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def count_distinct(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@_query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_union(spark, d):
    a, b = table(spark, d, "customer").where("c_acctbal > 9000"), table(spark, d, "supplier").where("s_acctbal < 0")
    return a.select(F.col("c_nationkey").alias("k")).union(b.select("s_nationkey")).distinct()


@_query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@_query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey"))


@_query("(SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT c_nationkey FROM customer")
def set_left_to_right(spark, d):
    """Set operators apply from left to right, as in the dialect of the queries."""
    left = table(spark, d, "nation").select(F.col("n_regionkey").alias("k")).union(table(spark, d, "region").select("r_regionkey")).distinct()
    return left.intersect(table(spark, d, "customer").select("c_nationkey"))


@_query("SELECT s_nationkey, max(s_acctbal) AS top, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS who FROM supplier GROUP BY s_nationkey")
def bare_column_beside_max(spark, d):
    """A bare column beside a single max comes from the row that has it; the smallest key on ties."""
    out = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top"), F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("who"))
    return out


@_query("SELECT c_custkey FROM customer WHERE (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND NOT c_nationkey = 3 AND c_custkey <> 7")
def where_and_or_not(spark, d):
    return table(spark, d, "customer").where("(c_acctbal < 0 or c_mktsegment = 'BUILDING') and not c_nationkey = 3 and c_custkey != 7").select("c_custkey")
