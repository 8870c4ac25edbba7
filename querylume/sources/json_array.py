"""JSON arrays of objects, read and written by many tasks, however the file breaks its lines.

A file is read in byte ranges, in pieces that end at closing braces. Where a range begins, nobody can tell whether that is
inside a string, or how deep. So a first pass sums each range up as a transition: for a begin outside and inside a string,
whether it ends inside one, how the depth changes, and how often it grows at which depth. The transitions are put together
range by range, a row each on the driver, and then every range knows its beginning and how many records begin before it. A
second pass cuts the ranges into records. Only of records that a range's end cuts, at most two a range, parts are shuffled,
to meet by the record's number.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylume.operators.storage import delete, frozen, shared_dir, thaw

# a string, closed or cut by the piece's end, or what changes the depth
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*(?:(")|\\?\Z)|[\[\]{}]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*(")?', re.S)
_OPENS = "[{"


def tokens(piece: str, inside: bool) -> tuple[list[tuple[int, int]], bool]:
    """Places at which the depth changes, with the changes, and whether the piece ends inside a string. The closing brace
    behind the piece isn't one of them."""
    at, out = 0, []
    if inside:
        rest = _REST.match(piece)
        if rest[1] is None:
            return out, True
        at = rest.end()
    for m in _TOKENS.finditer(piece, at):
        c = piece[m.start()]
        if c != '"':
            out.append((m.start(), 1 if c in _OPENS else -1))
        elif m[1] is None:
            return out, True
    return out, False


def transition(piece: str, inside: bool) -> tuple[bool, int]:
    """Where the piece and its closing brace lead: whether inside a string, and the change of depth."""
    found, inside = tokens(piece, inside)
    return inside, sum(d for _, d in found) - (not inside)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield (row["file"], row["start"]), row["value"]


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], list] = {}
    for key, piece in _ranges(batches):
        now = sums.setdefault(key, [(False, 0, Counter()), (True, 0, Counter())])
        for i, (inside, depth, grows) in enumerate(now):
            found, inside = tokens(piece, inside)
            for _, change in found:
                if change == 1:
                    grows[depth] += 1
                depth += change
            now[i] = inside, depth - (not inside), grows
    rows = [(f, s, i, *state) for (f, s), now in sums.items() for i, state in enumerate(now)]
    yield pa.RecordBatch.from_pylist([{"file": f, "start": s, "begins": bool(i), "ends": ends, "change": depth, "depths": list(grows), "grows": list(grows.values())} for f, s, i, ends, depth, grows in rows], schema=_SUMS)


_SUMS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("change", pa.int64()), ("depths", pa.list_(pa.int64())), ("grows", pa.list_(pa.int64()))])
_PARTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("idx", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])


def _cut(begins: dict[tuple[str, int], tuple[bool, int, int]]):
    """Records begin where the depth leaves 1. What comes before the first is the rest of one that an earlier range began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, before, text, out = None, 0, 0, [], []

        def flush(ended: bool = True) -> None:
            if text and (joined := "".join(text)):
                out.append({"file": key[0], "start": key[1], "idx": before + number - 1, "whole": ended and number > 0, "text": joined})
            text.clear()

        for now, piece in _ranges(batches):
            if now != key:
                flush(False)
                key, number = now, 0
                inside, depth, before = begins[key]
            found, ends_inside = tokens(piece, inside)
            at = 0
            for place, change in found:
                if depth == 1 and change == 1:
                    number, at = number + 1, place
                elif depth >= 2 and depth + change == 1:  # only by a bracket; braces end pieces
                    text.append(piece[at : place + 1])
                    flush()
                depth += change
            inside = ends_inside
            if depth >= 2:
                text.append(piece[at:] + "}")
            if not inside:
                depth -= 1
                if depth == 1:
                    flush()
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_PARTS)
                out = []
        flush(False)
        yield pa.RecordBatch.from_pylist(out, schema=_PARTS)

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """idx, value: the array's objects as text, numbered from 0; written to the shared folder. ``path`` is a file, or a folder
    whose part files make one array in the order of their names. Arrays in the array count, but aren't returned; plain values
    don't count."""
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    kinds = "file string, start long, begins boolean, ends boolean, change long, depths array<long>, grows array<long>"
    sums = {(r["file"], r["start"], r["begins"]): r for r in pieces.mapInArrow(_sum_up, kinds).collect()}  # two rows a range
    ranges = sorted({k[:2] for k in sums})
    begins, inside, depth, before = {}, False, 0, 0
    for (file, start), (following, _) in zip(ranges, [*ranges[1:], ("", 0)]):
        begins[file, start] = inside, depth, before
        r = sums[file, start, inside]
        before += dict(zip(r["depths"], r["grows"])).get(1 - depth, 0)
        # the last range of a file of several ends with a piece that no brace follows
        inside, depth = r["ends"], depth + r["change"]
        if following != file and not inside:
            depth += 1
    parts = frozen(pieces.mapInArrow(_cut(begins), "file string, start long, idx long, whole boolean, text string"), "json-parts", "zstd")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "start", "text"))), lambda x: x["text"]), "")
    joined = parts.where("not whole").groupBy("idx").agg(text.alias("value"))
    out = parts.where("whole").select("idx", F.col("text").alias("value")).union(joined).where(F.startswith("value", F.lit("{")))
    out._frozen_at = parts._frozen_at
    return out


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """The array's objects as rows: idx, and a column for each of their fields."""
    found = records(spark, path)
    # line feeds stand between tokens only; the place becomes a field, so that one reader finds the schema and the values
    line = F.regexp_replace(F.trim(F.regexp_replace("value", "[\r\n]+", " ")), r"^\{\s*", "")
    line = F.concat(F.lit('{"idx": '), F.col("idx").cast("string"), F.when(F.startswith(line, F.lit("}")), F.lit(" ")).otherwise(F.lit(", ")), line)
    folder = f"{shared_dir(spark)}/json-lines-{uuid.uuid4().hex}"
    found.select(line.alias("value")).write.option("compression", "snappy").text(folder)
    thaw(found)
    out = spark.read.json(folder)
    if "idx" not in out.columns:
        delete(spark, folder)
        return spark.createDataFrame([], "idx long")
    return out.select("idx", *[F.col(f"`{c}`") for c in out.columns if c != "idx"])


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's objects as lines of the array, the first of all and the last of all with the array's brackets. Equal keys
    are in one partition, so only the one that holds the least has a first row with it, and so for the last."""
    lines = lambda found: pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])
    held, last = None, False
    for batch in batches:
        if batch.num_rows:
            found = ["," + x for x in batch.column("value").to_pylist()]
            if held is not None:
                yield lines([held])
            elif batch.column("least")[0].as_py():
                found[0] = "[" + found[0][1:]
            held, last = found.pop(), batch.column("most")[-1].as_py()
            yield lines(found)
    if held is not None:
        yield lines([held + "]" * last])


def write_array(df: DataFrame, path: str, *order: str) -> None:
    """One object a row, in the order of ``order``: part files that make one array by the order of their names. Rows are dealt
    by ranges of ``order`` once, and nothing else is written."""
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high"))
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"), key.alias("key")).crossJoin(F.broadcast(ends))  # one row
    rows = rows.select("value", "key", F.col("key").eqNullSafe(F.col("low")).alias("least"), F.col("key").eqNullSafe(F.col("high")).alias("most"))
    rows.orderBy("key").select("value", "least", "most").mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)
