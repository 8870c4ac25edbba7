"""Relational operators that Spark has no DataFrame form for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Rows whose ``key`` is NOT IN the single column of ``others``, as SQL has it: none if ``others`` holds a null, none
    with a null key unless ``others`` is empty, and all if it is. An anti join and one row of counts, where Spark's own
    null-aware anti join has to broadcast a side or compare all pairs."""
    one = others.toDF("_other")
    facts = one.agg(F.count("*").alias("_n"), F.count_if(F.col("_other").isNull()).alias("_nulls"))
    kept = df.crossJoin(F.broadcast(facts))  # one row
    kept = kept.where((F.col("_n") == 0) | (F.col("_nulls") == 0) & F.col(key).isNotNull()).drop("_n", "_nulls")
    return kept.join(one.distinct(), kept[key] == F.col("_other"), "left_anti")
