"""Question, gold, prediction and report files."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylume.operators.storage import numbered
from querylume.sources.json_array import read_array

SQL_NAMES, LEVEL_NAMES = ("query", "sql_query", "sql"), ("difficulty", "hardness", "level")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions, with ``idx``: their place in the array, which is their identity. Read in ranges, see
    ``json_array``."""
    return read_array(spark, path)


def found_column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of several usual names that the table has."""
    return next((n for n in names if n in df.columns), None)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value: the lines of a file, or of a folder's part files by name, in their order. Files are read in splits;
    a line's place is its file, its split and its place in that."""
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line")]
    return numbered(spark.read.text(path).select("value", *where), "line_no", "_file", "_start", "_line").drop("_file", "_start", "_line")


def existing(folder: str, names: tuple[str, ...]) -> dict[str, bool]:
    """Which of the files are there."""
    return {name: os.path.exists(os.path.join(folder, name)) for name in names}


def part_files(path: str) -> list[str]:
    """The part files of a folder, in order."""
    return sorted(f.path for f in os.scandir(path) if f.name.startswith("part-"))


def one_file(path: str) -> str:
    """The part file of a folder that was written as one part."""
    return part_files(path)[0]


def gold_path(folder: str) -> str:
    """dev_gold.sql, or dev_gold where only that exists."""
    first = os.path.join(folder, "dev_gold.sql")
    return first if os.path.exists(first) else os.path.join(folder, "dev_gold")


def sample_indices(n: int, ratio: float, seed: int = 42) -> list[int]:
    """Places of a seeded sample without replacement of max(1, n * ratio) of n rows, in order."""
    return sorted(int(i) for i in np.random.default_rng(seed).choice(n, size=max(1, int(n * ratio)), replace=False)) if n else []


def sample(questions: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    chosen = questions.sparkSession.createDataFrame([(i,) for i in sample_indices(questions.count(), ratio, seed)], "idx long")
    return questions.join(chosen, "idx", "left_semi")


def write_lines(df: DataFrame, path: str, text: str, order: str = "idx") -> None:
    """One line a row, in the order of ``order``: part files whose names are in the order of their lines, as ``read_lines``
    takes them. Rows are dealt by ranges of ``order`` and written by as many tasks."""
    line = F.trim(F.regexp_replace(F.col(text), r"\s+", " ")).alias("value")
    df.orderBy(order).select(line).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, digits: dict[str, int], order: list[str]) -> None:
    """One file with a header, rows in order, numbers rounded."""
    cols = [F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]
    df.orderBy(*order).select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)
