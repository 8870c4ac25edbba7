"""Keys found in the data: unique columns, and columns whose values all occur in a unique column.

Every table is read twice. The first pass keeps a sketch of each column: the k smallest hashes of its values, with their exact
counts. A repeated hash proves that a column isn't unique, and a hash below the largest of another column's sketch that
isn't in it proves that the column has a value which the other lacks; neither is ever wrong, so only what is left has
to be looked up. The second pass shuffles the distinct values of those columns once, numbers and times as numbers. Each value gets
the set of columns that hold it, as bits. A column lies within those that are in the sets of all of its values, and is unique
if as many sets have it as it has rows.

Scale: the first pass sends k rows a column and task, the second one row a value and column. What comes to the driver is
k hashes and one set a column, as large as the schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SKETCH = 256
_WORD = 62  # columns whose bits share a number
#: What columns of one kind are compared as. Fractions and nested values are no keys.
KINDS = {"tinyint": "number", "smallint": "number", "int": "number", "bigint": "number", "string": "text", "date": "time", "timestamp": "time", "timestamp_ntz": "time"}
_LONGEST = 64  # longer texts are compared by their SHA-256

Name = tuple[str, str]


def kind_of(df: DataFrame, column: str) -> str | None:
    return KINDS.get(df.schema[column].dataType.simpleString())


def _value(column: str, kind: str) -> Column:
    c = F.col(f"`{column}`")
    if kind == "number":
        return c.cast("long")
    if kind == "time":
        return F.unix_micros(c.cast("timestamp"))
    return F.when(F.length(c) > _LONGEST, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def _smallest(numbers: list[int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in numbers]
        rows, filled = 0, [0] * len(numbers)
        for batch in batches:
            rows += batch.num_rows
            for i in range(len(numbers)):
                hashes = batch.column(i).drop_null().to_numpy()
                filled[i] += len(hashes)
                if len(held[i][0]) == k:  # what is larger than all that is held will not be held
                    hashes = hashes[hashes <= held[i][0][-1]]
                new, n = np.unique(hashes, return_counts=True)
                both, back = np.unique(np.concatenate([held[i][0], new]), return_inverse=True)
                held[i] = both[:k], np.bincount(back, np.concatenate([held[i][1], n]), len(both)).astype(np.int64)[:k]
        for number, (hashes, n), full in zip(numbers, held, filled):
            # a row without a hash has the rows and, in another, the values that aren't null
            yield pa.RecordBatch.from_pydict({"col": np.full(len(hashes) + 2, number), "hash": [None, None, *hashes.tolist()], "what": [0, 1] + [2] * len(hashes), "n": [rows, full, *n.tolist()]}, schema=_SKETCHED)

    return run


_SKETCHED = pa.schema([("col", pa.int64()), ("hash", pa.int64()), ("what", pa.int32()), ("n", pa.int64())])


def sketches(tables: dict[str, DataFrame], names: list[Name], k: int = SKETCH) -> list[dict]:
    """For each column of ``names``: rows, values (not null), and hashes, its k smallest with their counts."""
    parts = []
    for table, df in tables.items():
        own = [(i, c) for i, (t, c) in enumerate(names) if t == table]
        if own:
            hashed = [F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(_value(c, kind_of(df, c)))).alias(f"c{i}") for i, c in own]
            parts.append(df.select(*hashed).mapInArrow(_smallest([i for i, _ in own], k), "col long, hash long, what int, n long"))
    out = [{"rows": 0, "values": 0, "hashes": {}} for _ in names]
    if parts:
        met = reduce(DataFrame.union, parts).groupBy("col", "what", "hash").agg(F.sum("n").alias("n"))
        best = met.withColumn("_r", F.row_number().over(W.partitionBy("col", "what").orderBy("hash"))).where(F.col("_r") <= k)
        for r in best.collect():  # k rows a column
            if r["what"] == 2:
                out[r["col"]]["hashes"][r["hash"]] = r["n"]
            else:
                out[r["col"]][("rows", "values")[r["what"]]] = r["n"]
    return out


def may_be_unique(sketch: dict) -> bool:
    return 0 < sketch["rows"] == sketch["values"] and max(sketch["hashes"].values()) == 1


def may_lie_within(a: dict, b: dict, k: int = SKETCH) -> bool:
    """False only if a has a value that b lacks."""
    last = max(b["hashes"], default=None) if len(b["hashes"]) == k else None
    return all(h in b["hashes"] for h in a["hashes"] if last is None or h <= last)


def found_keys(tables: dict[str, DataFrame], alike: Callable[[Name, Name], bool] | None = None, k: int = SKETCH) -> tuple[set[Name], set[tuple[Name, Name]]]:
    """The unique columns (no null, no value twice, at least one row), and the pairs of a column with values and a unique
    column of another table and the same kind that holds all of them. ``alike`` limits the pairs that are asked."""
    names = [(t, c) for t, df in tables.items() for c in df.columns if kind_of(df, c)]
    kinds = [kind_of(tables[t], c) for t, c in names]
    drawn = sketches(tables, names, k)
    unique = {i for i, s in enumerate(drawn) if may_be_unique(s)}
    pairs = {
        (a, b) for b in unique for a in range(len(names))
        if names[a][0] != names[b][0] and kinds[a] == kinds[b] and drawn[a]["values"] and (alike is None or alike(names[a], names[b])) and may_lie_within(drawn[a], drawn[b], k)
    }
    asked = sorted(unique | {x for p in pairs for x in p})
    if not asked:
        return set(), set()
    place = {col: i for i, col in enumerate(asked)}
    words = range((len(asked) - 1) // _WORD + 1)
    has = lambda i: F.expr(f"(s{i // _WORD} & shiftleft(1L, {i % _WORD})) <> 0")
    row: dict[str, int] = {}
    for texts in (False, True):
        own = [i for i in asked if (kinds[i] == "text") == texts]
        parts = []
        for i in own:
            bits = [F.lit(1 << place[i] % _WORD if place[i] // _WORD == w else 0).cast("long").alias(f"s{w}") for w in words]
            parts.append(tables[names[i][0]].select(F.lit(kinds[i] == "time").alias("time"), _value(names[i][1], kinds[i]).alias("value"), *bits).where("value is not null"))
        if parts:
            sets = reduce(DataFrame.union, parts).groupBy("time", "value").agg(*[F.bit_or(f"s{w}").alias(f"s{w}") for w in words])
            each = [(place[i], [F.count_if(has(place[i])).alias(f"n{place[i]}"), *[F.bit_and(F.when(has(place[i]), F.col(f"s{w}"))).alias(f"c{place[i]}_{w}") for w in words]]) for i in own]
            row |= sets.agg(*[x for _, found in each for x in found]).first().asDict()
    held = lambda word, i: bool((word or 0) >> (i % _WORD) & 1)
    sure = {i for i in unique if row[f"n{place[i]}"] == drawn[i]["rows"]}  # none has nulls
    return {names[i] for i in sure}, {(names[a], names[b]) for a, b in pairs if b in sure and held(row[f"c{place[a]}_{place[b] // _WORD}"], place[b])}


#: Names that say nothing of what they are keys of.
_GENERIC = frozenset(("id", "key", "no", "nr", "code", ""))


def named_alike(a: Name, b: Name) -> bool:
    """Equal names; equal but for what stands before the first underscore, if what is left isn't generic; or the other
    table's name and its column's."""
    one, two = a[1].lower(), b[1].lower()
    bare = one.partition("_")[2]
    return one == two and one not in _GENERIC or bare == two.partition("_")[2] and bare not in _GENERIC or one == f"{b[0].lower()}_{two}"


def keys_of(tables: dict[str, DataFrame], alike: Callable[[Name, Name], bool] = named_alike) -> tuple[dict[str, str], dict[Name, Name]]:
    """Each table's primary key: its first unique column of numbers, or its first column, if that is unique. And for columns
    that lie within another table's primary key and have a name like it, that key; of several the one whose name is
    equal, then the first table's."""
    unique, pairs = found_keys(tables, alike)
    good = lambda t, df, i, c: (t, c) in unique and (i == 0 or kind_of(df, c) == "number")
    primary = {t: next((c for i, c in enumerate(df.columns) if good(t, df, i, c)), None) for t, df in tables.items()}
    order = list(tables)
    foreign: dict[Name, Name] = {}
    for a, b in sorted(pairs, key=lambda p: (p[0], p[0][1].lower() != p[1][1].lower(), order.index(p[1][0]))):
        if primary[b[0]] == b[1]:
            foreign.setdefault(a, b)
    return {t: c for t, c in primary.items() if c}, foreign
