"""Execution match: both queries are run, and their results compared column by column.

A column's key is its unit in the select list without the outer aggregate, foreign key columns by their group; of columns
with one key the last counts, and ``*`` stands for the first column. Order counts only where the gold query has ORDER BY,
since Spark promises none otherwise. Rows that a query's ORDER BY leaves tied go by the compared columns, in the order of the
gold query's select list on both sides, before a LIMIT cuts them: which of them comes first would be chance, and no difference.

Both comparisons stay in Spark, and as many pairs as a batch has are one job. Without order, the two sides are united with
opposite signs, and the rows whose signs don't add up to zero are counted. In order, every part of a result gives its number
of rows and an order-sensitive hash: the sum of its rows' hashes, each times a power of a base by its place in the part. Such
sums are put together in the order of the parts, whatever the bounds of the parts are, so only they come to the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylume.functions import sqlcompare as C
from querylume.functions.dialect import to_spark_sql
from querylume.functions.sqlparse import Query, Schema, try_parse

#: The order-sensitive hash is two sums modulo primes, of rows' hashes with seeds of their own; different results of one
#: length agree in both with a chance of about 2 ** -62.
_MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 69_069_069))
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits
#: Pairs whose comparisons are one Spark job.
BATCH = 16


def _keys(q: Query) -> list:
    return [(v.left, None, None) if v.right is None else (v.op, v.left, v.right) for _, v in q.select]


def run_sql(spark: SparkSession, text: str, tables: dict[str, list[str]], ties: tuple[int, ...] = ()) -> DataFrame:
    names = {c for cs in tables.values() for c in cs}
    whole = {f.name for t in tables for f in spark.table(t).schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    first, plain = (to_spark_sql(text, whole, names, anti_joins, ties) for anti_joins in (True, False))
    if first != plain:
        try:
            out = spark.sql(first)
            out.schema  # noqa: B018  analysis
            return out
        except PySparkException:
            pass
    return spark.sql(plain)


def _prepared(spark: SparkSession, gold: str, pred: str, tables: dict[str, list[str]], keys: dict[str, str]) -> tuple[DataFrame, DataFrame, bool] | bool:
    """Both results' columns in one order, and whether rows are in order; or what the match is without running them."""
    schema = Schema(tables)
    want, got = try_parse(gold, schema), try_parse(pred, schema)
    if want is None:
        raise ValueError("the gold query isn't in the accepted subset")
    places = lambda q: {k: i for i, k in enumerate(_keys(C.canonical(q, C.usable_columns(q.tables, schema), keys)))}
    b = places(want)
    right = run_sql(spark, gold, tables, tuple(b[k] + 1 for k in b))
    right.schema  # noqa: B018  analysis; an error of the gold query is an error
    if got is None:
        return False
    a = places(got)
    if a.keys() != b.keys():
        return False
    try:
        left = run_sql(spark, pred, tables, tuple(a[k] + 1 for k in b))
        left.schema  # noqa: B018
    except PySparkException:  # whatever is wrong with a prediction, it is no match
        return False
    pick = lambda df, at: df.toDF(*[f"x{i}" for i in range(len(df.columns))]).select(*[F.col(f"x{at[k]}").alias(f"c{j}") for j, k in enumerate(b)])
    left, right = pick(left, a), pick(right, b)
    kinds = [(x, y) for (_, x), (_, y) in zip(left.dtypes, right.dtypes)]
    if any((x == "string") != (y == "string") for x, y in kinds):
        return False
    if any(x != y for x, y in kinds):
        left, right = (df.select(*[F.col(c).cast("double" if x != y else x).alias(c) for c, (x, y) in zip(df.columns, kinds)]) for df in (left, right))
    return left, right, bool(want.order)


#: Bits of a digit, and digits that most places have.
_DIGIT, _LOW = 5, 4


def _power(base: int, prime: int, place: str) -> str:
    """SQL of base ** place modulo prime, by the digits of place."""
    factors = []
    for bit in range(0, _ROW_BITS, _DIGIT):
        powers = ", ".join(f"{pow(base, d << bit, prime)}L" for d in range(1 << _DIGIT))
        factors.append(f"array({powers})[CAST(shiftright({place}, {bit}) & {(1 << _DIGIT) - 1} AS INT)]")
    product = lambda some: functools.reduce(lambda x, y: f"({x} * {y} % {prime}L)", some)
    low, high = product(factors[:_LOW]), product(factors[_LOW:])
    return f"if(shiftright({place}, {_LOW * _DIGIT}) = 0, {low}, {low} * {high} % {prime}L)"


_SUMS = [f"sum(_h{i} * {_power(base, m, '_n')} % {m}L) % {m}L" for i, (m, base) in enumerate(_MODULI)]


def part_sums(df: DataFrame) -> DataFrame:
    """A row for each part of a result that has rows: part, n, h0, h1."""
    # hashes skip nulls, so whether a value is null is hashed beside it
    each = ", ".join(f"`{c}` IS NULL, `{c}`" for c in (c.replace("`", "``") for c in df.columns))
    hashed = [f"pmod(xxhash64({i}, {each}), {m}L) AS _h{i}" for i, (m, _) in enumerate(_MODULI)]
    rows = df.selectExpr(*hashed, "monotonically_increasing_id() AS _at")
    rows = rows.selectExpr("_h0", "_h1", f"shiftright(_at, {_ROW_BITS}) AS part", f"_at & {(1 << _ROW_BITS) - 1}L AS _n")
    return rows.groupBy("part").agg(F.count("*").alias("n"), *[F.expr(x).alias(f"h{i}") for i, x in enumerate(_SUMS)])


def folded(parts: Iterable[tuple[int, int, int, int]]) -> tuple[int, int, int]:
    """The number of rows and the hashes of a whole result, from its parts (part, n, h0, h1)."""
    n, sums = 0, [0] * len(_MODULI)
    for _, rows, *hashes in sorted(parts):
        for i, (m, base) in enumerate(_MODULI):
            sums[i] = (sums[i] + hashes[i] * pow(base, n, m)) % m
        n += rows
    return n, *sums


def _unlike(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many different rows one side has more often than the other."""
    both = left.withColumn("_s", F.lit(1)).union(right.withColumn("_s", F.lit(-1)))
    return both.groupBy(*left.columns).agg(F.sum("_s").alias("_d")).where("_d <> 0").agg(F.count("*").alias("n"))


def _results(waiting: list[tuple[int, DataFrame, DataFrame, bool]]) -> list[tuple[int, bool]]:
    """(idx, left, right, ordered) to (idx, whether the results agree), by one job. What several pairs order alike, as
    pairs with one gold query do, is run once."""
    zero = F.lit(0).cast("long")
    sides: list[DataFrame] = []
    of: dict[int, list[int]] = {}
    jobs = []
    for idx, left, right, ordered in waiting:
        if ordered:
            of[idx] = []
            for df in (left, right):
                at = next((i for i, known in enumerate(sides) if known.sameSemantics(df)), len(sides))
                if at == len(sides):
                    sides.append(df)
                of[idx].append(at)
        else:
            jobs.append(_unlike(left, right).select(F.lit(idx).cast("long").alias("idx"), F.lit(-1).alias("side"), zero.alias("part"), "n", zero.alias("h0"), zero.alias("h1")))
    jobs += [part_sums(df).select(zero.alias("idx"), F.lit(i).alias("side"), "part", "n", "h0", "h1") for i, df in enumerate(sides)]
    rows = functools.reduce(DataFrame.union, jobs).collect()
    whole = [folded((r["part"], r["n"], r["h0"], r["h1"]) for r in rows if r["side"] == i) for i in range(len(sides))]
    unlike = {r["idx"]: r["n"] for r in rows if r["side"] < 0}
    return [(idx, whole[of[idx][0]] == whole[of[idx][1]] if ordered else unlike[idx] == 0) for idx, _, _, ordered in waiting]


def _one(left: DataFrame, right: DataFrame, ordered: bool) -> bool:
    try:
        return _results([(0, left, right, ordered)])[0][1]
    except PySparkException:
        right.write.format("noop").mode("overwrite").save()  # an error of the gold query is raised here
        return False


def matches(spark: SparkSession, gold: str, pred: str, tables: dict[str, list[str]], keys: dict[str, str] | None = None) -> bool:
    """False where the prediction fails, as it is analysed or as it runs; an error where the gold query does. ``keys``
    has the canonical ids of foreign key columns."""
    found = _prepared(spark, gold, pred, tables, keys or {})
    return found if isinstance(found, bool) else _one(*found)


def match_all(pairs: DataFrame, schema_of: Callable[[str], tuple[dict[str, list[str]], dict[str, str]]], use: Callable[[str], None] | None = None) -> DataFrame:
    """(idx, db_id, gold, pred) to (idx, exec). ``schema_of`` gives a database's tables and keys, and ``use`` makes its tables
    the session's; both are called once a database.

    Queries can only be planned on the driver, so the pairs, a benchmark's texts, pass through it, a partition at a time;
    their results stay in Spark. BATCH comparisons are one job. A batch in which a query fails is run again pair by pair."""
    spark, out, db, known = pairs.sparkSession, [], None, ({}, {})
    waiting: list[tuple[int, DataFrame, DataFrame, bool]] = []

    def run() -> None:
        if waiting:
            try:
                out.extend(_results(waiting))
            except PySparkException:
                out.extend((idx, _one(*rest)) for idx, *rest in waiting)
            waiting.clear()

    for r in pairs.select("idx", "db_id", "gold", "pred").orderBy("db_id", "idx").toLocalIterator():
        if r["db_id"] != db:
            run()  # plans are bound to the tables of the database they were made with
            db = r["db_id"]
            known = schema_of(db)
            if use:
                use(db)
        found = _prepared(spark, r["gold"], r["pred"], *known)
        if isinstance(found, bool):
            out.append((r["idx"], found))
        else:
            waiting.append((r["idx"], *found))
            if len(waiting) == BATCH:
                run()
    run()
    return spark.createDataFrame(out, "idx long, exec boolean")
