"""Cutting lineage in iterative operators: tables written once to the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where that is unset, a local master
    gets a temporary folder, the same for the whole process, and any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local_folder()
    return found.rstrip("/")


def frozen(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back. Lineage ends there, lost executors cost only the tasks that
    they ran, and values that depend on row placement stay as they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._frozen_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def thaw(*tables: DataFrame) -> None:
    """Deletes frozen tables that nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t._frozen_at)


def numbered(df: DataFrame, name: str, *keys: str | Column, what: str = "numbered") -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in the order of ``keys``, or without keys in the order of partitions and the rows in
    them, which for one text file is that of its lines. A range exchange sorts in parallel; only the row counts of
    partitions come to the driver. Frozen, for the numbers must not change on a later read."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    placed = frozen(placed.withColumn("_at", F.monotonically_increasing_id()), what)
    part = F.shiftright("_at", _ROW_BITS)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _before long")
    out = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")  # a row a partition
    out = out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_p", "_before", "_at")
    out._frozen_at = placed._frozen_at
    return out
