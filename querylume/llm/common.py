"""What the operators of this subpackage share: names of their own for columns, joins that stand hot keys, and connected
components. Tables in the shared folder are those of ``querylume.operators.storage``."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylume.operators.storage import delete, frozen as freeze, numbered, shared_dir, thaw as drop_frozen  # noqa: F401

#: A key with more than this share of all rows is joined by broadcast; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 2000


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map function that gives its memory back at the end of a task, for workers outlive tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], count: str, total: int, any_hot: bool | None = None) -> DataFrame:
    """Inner equi join to a side with one row a key whose column ``count`` says how many rows of ``big`` have it.
    Keys with more than HOT_SHARE of ``total`` rows, of which there are at most 1 / HOT_SHARE, are broadcast: their
    rows in ``big`` stay where they are. The others are shuffled. ``count`` is kept. Whether there are such keys is
    looked up, unless ``any_hot`` says so."""
    least = hot_from(total)
    hot, rest = small.where(F.col(count) > least), small.where(F.col(count) <= least)
    if not (hot.limit(1).count() if any_hot is None else any_hot):
        return big.join(small, keys)
    listed = F.broadcast(hot.select(*keys))
    return big.join(F.broadcast(hot), keys).unionByName(big.join(listed, keys, "left_anti").join(rest, keys))


def hot_from(total: int) -> int:
    """Keys of more than so many of ``total`` rows are hot."""
    return max(100, int(total * HOT_SHARE))  # at most 1 / HOT_SHARE keys have more, whatever the total


def components(edges: DataFrame, what: str) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) for each node that has an edge, root
    being the component's smallest node. Large-star and small-star steps in turn; each aggregates and joins by node, so
    nothing is gathered. A node with very many neighbours keeps only the smallest of them in a pre-aggregate, and is
    joined to them by join_hot, so that they stay where they are."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame) -> tuple:
        """Rows, a sum that changes with them, and the most neighbours that a smaller node has."""
        per = e.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        return tuple(per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first())

    cur = freeze(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{what}-edges")
    marks = state(cur)
    while True:
        # large star: every larger neighbour of a node is tied to the smallest of the node and its neighbours
        near, total = both(cur), 2 * marks[0]
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_hot(near.where("b > a"), low, ["a"], "n", total, marks[2] > hot_from(total))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour of a node, and the node, are tied to the smallest neighbour
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        nxt = freeze(small.where("a <> b").distinct(), f"{what}-edges")
        now = state(nxt)
        drop_frozen(cur)
        cur = nxt
        if now == marks:
            break
        marks = now
    roots = cur.select("b").distinct()
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
    out._frozen_at = cur._frozen_at
    return out
