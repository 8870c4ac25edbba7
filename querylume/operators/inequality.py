"""Joins on two inequalities and nothing else, without a nested loop over rows.

To count matches, the rows of both sides are cut into slabs by each of their keys. The right rows beyond a left row are those
of its own slab of x, which are compared there; those of later slabs of x in its own slab of y, which are compared there; and
those of later slabs of both keys, which a table of counts gives. So every row is sent to two slabs, whatever it matches.

To list pairs, both sides are sorted by their first key and cut into blocks of equal size. A block of the left side can only
match the right blocks from the first on whose largest first key is beyond its least one, and of these only those whose range
of second keys reaches beyond its own; other pairs of blocks never meet. Pairs of blocks are dealt evenly over the tasks, and
are compared row by row, as matrices of bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querylume.operators.storage import frozen, numbered

BLOCK = 4096
#: Rows of a slab, and slabs at most; beyond them slabs grow.
SLAB, SLABS = 1 << 18, 1024
#: Tasks at most over which pairs of blocks are dealt.
TASKS = 8192
#: Rows of pairs that go out together.
_OUT = 1 << 16
#: Bits of a matrix.
_MATRIX = 1 << 20


def _blocks(df: DataFrame, id_: Column, x: Column, y: Column, side: str) -> DataFrame:
    """A row a block: its number, and its rows' ids and keys in the order of x. Rows with a null key match nothing."""
    rows = df.select(id_.alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    placed = numbered(rows, "place", "x", what=f"inequality-{side}")
    packed = placed.groupBy(F.floor(F.col("place") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("x", "y", "id"))).alias("rows"))  # at most BLOCK
    part = lambda c: F.transform("rows", lambda r: r[c])
    return packed.select(*[c.alias(f"{side}_{n}") for n, c in (("block", F.col("block")), ("id", part("id")), ("x", part("x")), ("y", part("y")))])


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of blocks that may hold a match of x < x and y < y."""
    range_of = lambda df, s: df.select(F.col(f"{s}_block").alias(s), F.array_min(f"{s}_x").alias(f"{s}_x0"), F.array_max(f"{s}_x").alias(f"{s}_x1"), F.array_min(f"{s}_y").alias(f"{s}_y0"), F.array_max(f"{s}_y").alias(f"{s}_y1"))
    # blocks are in the order of x, so those that reach beyond a left block are the last ones; to count those that don't, the
    # ends of right blocks and the beginnings of left blocks are sorted together, an end before an equal beginning
    ends = range_of(right, "r").select("r", "r_x1", "r_y1")
    none = lambda kind: F.lit(None).cast(kind)
    asks = range_of(left, "l").select(F.col("l_x0").alias("v"), F.col("l"), "l_y0")
    both = asks.unionByName(ends.select(F.col("r_x1").alias("v"), none("long").alias("l"), none("double").alias("l_y0")))
    placed = numbered(both, "place", F.col("v"), F.col("l").asc_nulls_first(), what="inequality-ends").where("l is not null")
    total = ends.count()
    first = placed.select("l", "l_y0", (F.col("place") - F.col("l")).alias("_first")).where(F.col("_first") < total)  # l left blocks stand before
    pairs = first.select("l", "l_y0", F.explode(F.sequence("_first", F.lit(total - 1).cast("long"))).alias("r"))
    return pairs.join(ends, "r").where("l_y0 < r_y1").select("l", "r")


def _arrays(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].values if isinstance(c[i], pa.ListScalar) else c[i].as_py() for c in columns)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, lx, ly, others, rx, ry in _arrays(batches, ["l_id", "l_x", "l_y", "r_id", "r_x", "r_y"]):
        lx, ly, rx, ry = (a.to_numpy() for a in (lx, ly, rx, ry))
        for first in range(0, len(lx), some := 1 + _MATRIX // len(rx)):
            a, b = np.nonzero((lx[first : first + some, None] < rx) & (ly[first : first + some, None] < ry))
            for at in range(0, len(a), _OUT):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[at : at + _OUT] + first)), others.take(pa.array(b[at : at + _OUT]))], ["l_id", "r_id"])


def _slabs(v: np.ndarray, bounds: np.ndarray, right: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The slab of each value. A value that is a bound may stand in the slabs on both sides of it, and one that is several
    bounds in all between; its right rows are spread over the first half of these and its left rows over the second, so that
    no right row is in a later slab than a left row with the same value."""
    low, high = np.searchsorted(bounds, v, "left"), np.searchsorted(bounds, v, "right")
    middle = (low + high) // 2
    return np.where(right, low + spread % (middle - low + 1), middle + spread % (high - middle + 1)).astype(np.int32)


def _beyond(x: np.ndarray, y: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row that isn't right, how many right rows have both keys beyond its own.

    Rows are numbered in the order of x, right ones first where keys are equal, and lie in that of y. A pair of numbers in
    order has a highest bit in which they differ: for each bit, rows with equal bits above it are one group, and in a group
    the left rows without the bit count the right rows with it that come later. Groups are then parted by the bit."""
    m = len(x)
    number, at = np.empty(m, np.int64), np.lexsort((~right, y))
    number[np.lexsort((~right, x))] = np.arange(m)
    number, right, n, places = number[at], right[at], np.zeros(m, np.int64), np.arange(m)
    for bit in reversed(range(max(m - 1, 0).bit_length())):
        start = number >> (bit + 1) << (bit + 1)
        with_bit = (number >> bit & 1).astype(bool)
        counted = np.cumsum(right & with_bit)
        asks = np.flatnonzero(~right & ~with_bit)
        n[at[asks]] += counted[np.minimum(start[asks] + (2 << bit), m) - 1] - counted[asks]
        ones = np.cumsum(with_bit) - with_bit
        ones -= ones[start]
        to = np.where(with_bit, start + (1 << bit) + ones, places - ones)
        number[to], right[to], at[to] = number.copy(), right.copy(), at.copy()
    return n


def _joined(left: DataFrame, right: DataFrame, left_keys: tuple, right_keys: tuple) -> DataFrame:
    a, b = _blocks(left, *left_keys, "l"), _blocks(right, *right_keys, "r")
    met = frozen(_met(a, b), "inequality-met")
    tasks = max(1, min(met.count(), TASKS))
    return met.join(a, met["l"] == a["l_block"]).join(b, met["r"] == b["r_block"]).repartition(tasks)


def match_counts(left: DataFrame, right: DataFrame, left_keys: tuple[Column, Column, Column], right_keys: tuple[Column, Column, Column]) -> DataFrame:
    """(id, n): for each left id with a match, how many right rows have both keys beyond its own. Keys are (id, x, y), and a
    pair matches where x < x and y < y; negate a key to turn its inequality round. Rows of one id add up. Rows with a
    null key match nothing. The bounds of slabs are approximate quantiles; they only say which task does what."""
    kind = left.select(left_keys[0].alias("id")).schema["id"].dataType.simpleString()
    keyed = lambda df, k, r: df.select((F.lit(None).cast(kind) if r else k[0]).alias("id"), k[1].cast("double").alias("x"), k[2].cast("double").alias("y"), F.lit(r).alias("right"), F.pmod(F.xxhash64(*k), F.lit(1 << 20)).alias("spread"))
    rows = keyed(left, left_keys, False).union(keyed(right, right_keys, True)).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    slabs = max(1, min(SLABS, -(-rows.count() // SLAB)))
    bounds = [np.empty(0), np.empty(0)]
    if slabs > 1:
        shares = [i / slabs for i in range(1, slabs)]
        bounds = [np.array(b) for b in rows.agg(*[F.percentile_approx(c, shares, 10 * SLABS) for c in "xy"]).first()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, right, spread = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "right", "spread"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(_slabs(v, b, right, spread)) for v, b in ((x, bounds[0]), (y, bounds[1]))]], ["id", "x", "y", "right", "xs", "ys"])

    def counted(rows: pa.Table, x: str, later: np.ndarray | None = None) -> pa.Table:
        xs, ys, right = (rows.column(c).to_numpy() for c in (x, "y", "right"))
        n = _beyond(xs, ys, right)
        if later is not None:
            n += later[xs]
        found = pa.array(~right & (n > 0))
        return pa.table([rows.column("id").filter(found), pa.array(n).filter(found)], names=["id", "n"])

    def own_y(rows: pa.Table, cells: pa.Table) -> pa.Table:
        later = np.zeros(slabs + 1, np.int64)  # right rows of later slabs of y, by their slab of x
        later[cells.column("xs").to_numpy()] = cells.column("later").to_numpy()
        return counted(rows, "xs", later[::-1].cumsum()[::-1][1:])

    placed = rows.mapInArrow(place, f"id {kind}, x double, y double, right boolean, xs int, ys int")
    grid = rows.sparkSession.range(slabs * slabs).select((F.col("id") % slabs).cast("int").alias("xs"), F.floor(F.col("id") / slabs).cast("int").alias("ys"))
    cells = grid.join(placed.where("right").groupBy("xs", "ys").agg(F.count("*").alias("n")), ["xs", "ys"], "left")
    later = F.sum("n").over(W.partitionBy("xs").orderBy(F.desc("ys")).rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("xs", "ys", F.coalesce(later, F.lit(0)).alias("later")).where("later > 0")
    in_x = placed.select("id", "x", "y", "right", "xs").groupBy("xs").applyInArrow(lambda t: counted(t, "x"), f"id {kind}, n long")
    in_y = placed.select("id", "y", "right", "xs", "ys").groupBy("ys").cogroup(cells.groupBy("ys")).applyInArrow(own_y, f"id {kind}, n long")
    return in_x.union(in_y).groupBy("id").agg(F.sum("n").alias("n"))


def match_pairs(left: DataFrame, right: DataFrame, left_keys: tuple[Column, Column, Column], right_keys: tuple[Column, Column, Column]) -> DataFrame:
    """(l_id, r_id) for each pair of matching rows; keys as for ``match_counts``."""
    kinds = [df.select(k[0].alias("id")).schema["id"].dataType.simpleString() for df, k in ((left, left_keys), (right, right_keys))]
    return _joined(left, right, left_keys, right_keys).select("l_id", "l_x", "l_y", "r_id", "r_x", "r_y").mapInArrow(_pairs, f"l_id {kinds[0]}, r_id {kinds[1]}")
