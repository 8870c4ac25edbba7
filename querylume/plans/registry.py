"""Names of all queries, their functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querylume.plans import evaluation, linking, relational, reports, retrieval, runs, schema, spread, texts

MODULES = (relational, schema, linking, texts, evaluation, reports, retrieval, spread)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in m.ORACLE.items()}
