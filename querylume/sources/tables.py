"""User tables: Parquet files of one database as DataFrames or as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
CORPUS = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = STAR + CORPUS) -> None:
    """Temporary views, so that SQL text can name the tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def register_database(spark: SparkSession, folder: str, db_id: str) -> None:
    """The tables of one database, ``folder``/``db_id``/<table>.parquet, as temporary views, whatever store they are in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{db_id}")
    for found in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        name = found.getPath().getName()
        if name.endswith(".parquet"):
            spark.read.parquet(f"{folder}/{db_id}/{name}").createOrReplaceTempView(name.removesuffix(".parquet").lower())
