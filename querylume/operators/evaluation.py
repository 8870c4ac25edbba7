"""Scoring predicted SQL against gold SQL: one row a pair and part, then aggregates by difficulty.

Pairs and catalogue meet by database: a group holds some of a database's pairs and its schema, which is parsed there, in the
task, once for all of them. The pairs of a large database are dealt into several groups, and only its schema is copied to
each. A gold query that doesn't parse is an error; a prediction that doesn't parse is an empty query.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from querylume.functions import sqlcompare as C
from querylume.functions.sqlparse import Schema, parse, try_parse
from querylume.operators.storage import frozen, numbered

PAIR_SCHEMA = "idx long, db_id string, level string, parsed boolean, exact boolean, part string, gold_total int, pred_total int, score int"


#: Pairs of a database that one group holds on average.
GROUP = 2000
_CATALOG = ("col_idx", "table", "column", "fk_table", "fk_column")


def schema_from(rows: list[dict]) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Of one database's catalogue rows: its tables with their columns, and the canonical ids of its foreign key columns."""
    rows = sorted(rows, key=lambda r: r["col_idx"])
    tables: dict[str, list[str]] = {}
    for r in rows:
        if r["column"] != "*":
            tables.setdefault(r["table"], []).append(r["column"])
    columns = [(r["table"], r["column"]) for r in rows]
    at = {(t.lower(), c.lower()): i for i, (t, c) in enumerate(columns)}
    return tables, C.key_groups(columns, [(i, at[r["fk_table"].lower(), r["fk_column"].lower()]) for i, r in enumerate(rows) if r["fk_table"]])


def schemas_in(catalog: DataFrame) -> Callable[[str], tuple[dict[str, list[str]], dict[str, str]]]:
    """For the driver, which plans queries: the schema of one database when it is asked for."""
    return lambda db: schema_from([r.asDict() for r in catalog.where(F.col("db_id") == db).select(*_CATALOG).collect()])  # one schema


def with_schemas(rows: DataFrame, catalog: DataFrame, each: Callable[[list[dict], Schema, dict[str, str]], list[dict]], schema: str, group: int = GROUP) -> DataFrame:
    """``each`` of the rows (idx, db_id, ...) of a group, with their database's schema and keys. A database with more than
    ``group`` rows has several groups, each with the schema; rows of a database that isn't in the catalogue are an error."""
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    parts = rows.groupBy("db_id").agg(F.ceil(F.count("*") / group).alias("_parts"))
    dealt = rows.join(parts, "db_id").withColumn("_part", F.pmod(F.xxhash64("idx"), "_parts")).drop("_parts")
    copied = catalog.select("db_id", *_CATALOG).join(parts, "db_id").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts").withColumnRenamed("db_id", "_db")

    def run(key: tuple, some: pa.Table, columns: pa.Table) -> pa.Table:
        if some.num_rows and not columns.num_rows:
            raise KeyError(f"the catalogue has no database {key[0].as_py()}")
        tables, keys = schema_from(columns.to_pylist())
        out = each(some.to_pylist(), Schema(tables), keys) if some.num_rows else []
        return pa.Table.from_pylist(out, schema=kinds)

    return dealt.groupBy("db_id", "_part").cogroup(copied.groupBy("_db", "_copy")).applyInArrow(run, schema)


def _normal(q, schema: Schema, keys: dict[str, str]):
    return C.canonical(C.without_values(q), C.usable_columns(q.tables, schema), keys)


def _compare(rows: list[dict], schema: Schema, keys: dict[str, str]) -> list[dict]:
    out = []
    for r in rows:
        gold, pred = parse(r["gold"], schema), try_parse(r["pred"], schema)
        head = {"idx": r["idx"], "db_id": r["db_id"], "level": C.hardness(gold), "parsed": pred is not None}
        gold, pred = _normal(gold, schema, keys), _normal(pred or C.EMPTY, schema, keys)
        head["exact"] = C.exact(pred, gold)
        out += [head | {"part": part, "gold_total": g, "pred_total": p, "score": C.points(g, p, n)} for part, (g, p, n) in C.partial_counts(pred, gold).items()]
    return out


def compare(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(idx, db_id, gold, pred) to one row for each pair and part."""
    return with_schemas(pairs.select("idx", "db_id", "gold", "pred"), catalog, _compare, PAIR_SCHEMA)


def _parsed(rows: list[dict], schema: Schema, _: dict[str, str]) -> list[dict]:
    out = []
    for r in rows:
        q = try_parse(r["sql"], schema)
        clauses, below, others = C.counts(q) if q else (None, None, None)
        out.append({"idx": r["idx"], "db_id": r["db_id"], "ast": json.dumps(q.to_dict()) if q else None, "level": C.hardness(q) if q else None, "clauses": clauses, "below": below, "others": others})
    return out


def parse_all(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(idx, db_id, sql) to the tree as JSON, the difficulty and its counts; nulls where the text doesn't parse."""
    return with_schemas(queries.select("idx", "db_id", "sql"), catalog, _parsed, "idx long, db_id string, ast string, level string, clauses long, below long, others long")


def _share(of: Column, where: Column) -> Column:
    return F.coalesce(F.avg(F.when(where, of)), F.lit(0.0))


def rollup_scores(parts: DataFrame) -> DataFrame:
    """level ('all' for the total), part, accuracy (over pairs whose prediction has the part), recall (over pairs whose
    gold has it), f1 (1 where both are 0), count."""
    s = F.col("score").cast("double")
    out = parts.rollup("part", "level").agg(F.grouping_id("part", "level").alias("_g"), _share(s, F.col("pred_total") > 0).alias("accuracy"), _share(s, F.col("gold_total") > 0).alias("recall"), F.count("*").alias("count"))
    a, r = F.col("accuracy"), F.col("recall")
    f1 = F.when((a == 0) & (r == 0), 1.0).otherwise(2 * a * r / (a + r))
    return out.where("_g < 2").select(F.when(F.col("_g") == 1, "all").otherwise(F.col("level")).alias("level"), "part", F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), "count")


def exact_by_level(parts: DataFrame) -> DataFrame:
    """level ('all' for the total), count, exact."""
    pairs = parts.select("idx", "level", "exact").distinct()
    out = pairs.rollup("level").agg(F.grouping_id("level").alias("_g"), F.count("*").alias("count"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("level")).alias("level"), "count", "exact")


ETYPES = ("all", "exec", "match")


def pair_lines(gold_lines: DataFrame, pred_lines: DataFrame) -> DataFrame:
    """Gold and prediction texts (line_no, value) to (idx, db_id, gold, pred). Blank lines are dropped first, then lines
    are paired by what is left; the longer file's rest has no partner."""

    def kept(df: DataFrame) -> DataFrame:
        return numbered(df.where(F.trim("value") != ""), "idx", "line_no")

    g = kept(gold_lines).select("idx", F.split(F.trim("value"), "\t").alias("g"))
    p = kept(pred_lines).select("idx", F.split(F.trim("value"), "\t")[0].alias("pred"))
    return g.join(p, "idx").select("idx", F.col("g")[1].alias("db_id"), F.col("g")[0].alias("gold"), "pred")


def evaluate(pairs: DataFrame, catalog: DataFrame, etype: str = "all", execute: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Scores of all pairs (idx, db_id, gold, pred): level ('easy' to 'extra', and 'all'), metric, part, value.

    Metrics are count; with etype all or exec, execution accuracy (exec); with all or match, exact match (exact) and for
    each of the ten parts accuracy, recall and f1. ``execute`` maps the pairs to (idx, exec); it runs both queries. Levels
    without a pair have no row. A gold query that doesn't parse or run is an error."""
    if etype not in ETYPES:
        raise ValueError(f"etype is one of {ETYPES}")
    parts = frozen(compare(pairs, catalog), "evaluation-parts")
    per_pair = parts.select("idx", "level", F.col("exact").cast("double").alias("exact")).distinct()
    metrics = [F.count("*").cast("double").alias("count")]
    if etype != "match":
        if execute is None:
            raise ValueError("execution accuracy needs a way to run the queries")
        per_pair = per_pair.join(execute(pairs), "idx")
        metrics.append(F.avg(F.col("exec").cast("double")).alias("exec"))
    if etype != "exec":
        metrics.append(F.avg("exact").alias("exact"))
    names = ["count", *(["exec"] if etype != "match" else []), *(["exact"] if etype != "exec" else [])]
    whole = per_pair.rollup("level").agg(F.grouping_id("level").alias("_g"), *metrics)
    level = F.when(F.col("_g") == 1, "all").otherwise(F.col("level")).alias("level")
    out = whole.where("_g = 0 or count > 0").select(level, *names).unpivot(["level"], names, "metric", "value").select("level", "metric", F.lit("").alias("part"), F.round("value", 6).alias("value"))
    if etype != "exec":
        scored = rollup_scores(parts).select("level", "part", "accuracy", "recall", "f1").unpivot(["level", "part"], ["accuracy", "recall", "f1"], "metric", "value")
        out = out.unionByName(scored.select("level", "metric", "part", "value"))
    return out
