"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes ends a piece wherever it is -1 modulo the block size; each piece gives one
character of 64. Behind RUN equal pieces in a row the rest of the run is one piece. The block size doubles with the text's
length until at most LONGEST pieces are likely, halves while there are less than half as many, and doubles again while there
are more, so that all of a text is in its signature. A second signature at twice the block size, which has no more pieces,
makes texts of half or double the length comparable. Two fingerprints with compatible
block sizes are compared by edit distance (insertions and deletions) of their signatures, if these share a run of RUN
characters at all.

Scale: documents are range-partitioned by id once, so that each meets its successor in a stream; what lies at the ends
of partitions is written as two rows each, and joined. Nothing else moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylume.llm.common import freeze, table

WINDOW = 7
SMALLEST = 3
LONGEST = 64
RUN = 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


class Fingerprinter:
    def __init__(self):
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 1 << 16, 2 * len(self.powers))
            self.powers = np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
            self.inverses = np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BACK, np.uint64)]).cumprod(dtype=np.uint64)

    @staticmethod
    def _rolling(data: np.ndarray) -> np.ndarray:
        """Sum, weighted sum and shifted xor of the last WINDOW bytes, added up modulo 2**32."""
        x = np.zeros(len(data) + WINDOW - 1, np.uint32)
        x[WINDOW - 1 :] = data
        n = len(data)
        total, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        for k in range(WINDOW):
            part = x[WINDOW - 1 - k : WINDOW - 1 - k + n]
            total += part * np.uint32(WINDOW - k + 1)
            mixed ^= part << np.uint32(5 * k)
        return total + mixed

    def _pieces(self, prefix: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the pieces that ``ends`` cut, and where the pieces stop."""
        stops = np.append(ends, n) if not len(ends) or ends[-1] < n else ends
        starts = np.append(0, stops[:-1])
        h = (prefix[stops] - prefix[starts]) * self.inverses[starts]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), stops

    def _merged(self, prefix: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """``ends`` without those inside a run of equal pieces, behind its RUN-th: the rest of a run is one piece."""
        h, stops = self._pieces(prefix, ends, n)
        same = np.append(False, h[1:] == h[:-1])
        place = np.arange(len(h))
        run = place - np.maximum.accumulate(np.where(same, 0, place))  # equal pieces before, in a row
        keep = (run < RUN - 1) | np.append(~same[1:], True)
        return stops[keep & (stops < n)]

    def _signature(self, prefix: np.ndarray, ends: np.ndarray, n: int) -> str:
        h, _ = self._pieces(prefix, ends, n)
        return _LETTERS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    def __call__(self, text: str) -> str:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(data)
        if not n:
            return f"{SMALLEST}::"
        self._grow(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64, out=prefix[1:])
        roll = self._rolling(data)

        def ends_of(size: int) -> np.ndarray:
            found = np.flatnonzero(roll % np.uint32(size) == size - 1) + 1 if size < 1 << 32 else np.zeros(0, np.int64)
            return self._merged(prefix, found, n)

        size = SMALLEST
        while size * LONGEST < n:
            size *= 2
        while size > SMALLEST and len(ends_of(size)) < LONGEST // 2 - 1:
            size //= 2
        while len(ends := ends_of(size)) > LONGEST - 1:
            size *= 2
        return f"{size}:{self._signature(prefix, ends, n)}:{self._signature(prefix, ends_of(2 * size), n)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    run = min(RUN, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """From 0 (nothing in common, or incompatible block sizes) to 1 (equal)."""
    if a == b:
        return 1.0
    (n, one, two), (m, three, four) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_alike(one, three), _alike(two, four))
    if n == 2 * m:
        return _alike(one, four)
    if m == 2 * n:
        return _alike(two, three)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the start of another text, or all of that."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(make: Fingerprinter, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following)
    changed_mark = make(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, changed_mark, likeness(mark, changed_mark), likeness(mark, next_mark)


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of id. The first and the last row of the partition go out with their text, to be met by another's."""
    make, held, pid = Fingerprinter(), None, TaskContext.get().partitionId()
    for pdf in batches:
        ids, rows, edge = [], [], []
        for id_, text in zip(pdf["id"], pdf["text"]):
            text = text or ""
            mark = make(text)
            if held is None:
                edge.append((0, id_, text, mark))
            else:
                ids.append(held[0])
                rows.append(_row(make, held[1], held[2], text, mark))
            held = id_, text, mark
        if rows:
            out = pd.DataFrame(rows, columns=_NAMES)
            out.insert(0, "id", pd.Series(ids, dtype=pdf["id"].dtype))
            yield out.assign(_edge=-1, _pid=pid, _text=None)
        for kind, id_, text, mark in edge:
            yield pd.DataFrame({"id": pd.Series([id_], dtype=pdf["id"].dtype), "n_chars": [len(text)], "edited_sha256": [None], "fingerprint": [mark], "edited_fingerprint": [None], "near_edited": [0.0], "near_next": [0.0], "_edge": [kind], "_pid": [pid], "_text": [text]})
        kind_of_id = pdf["id"].dtype
    if held is not None:
        yield pd.DataFrame({"id": pd.Series([held[0]], dtype=kind_of_id), "n_chars": [len(held[1])], "edited_sha256": [None], "fingerprint": [held[2]], "edited_fingerprint": [None], "near_edited": [0.0], "near_next": [0.0], "_edge": [1], "_pid": [pid], "_text": [held[1]]})


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    make = Fingerprinter()
    for pdf in batches:
        rows = [_row(make, a, b, c, d) for a, b, c, d in zip(pdf["text"], pdf["mark"], pdf["next_text"], pdf["next_mark"])]
        out = pd.DataFrame(rows, columns=_NAMES)
        out.insert(0, "id", pdf["id"])
        yield out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; 'edited' and 'next' refer to the following row by ascending id, the first row following the last.

    A null text counts as empty; two empty texts have likeness 1. Null ids come first; rows with one id are in order of
    their text. A single row follows itself. Other columns are ignored. An empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    placed = placed.withColumn("id", F.col("id").cast("string"))  # as text: pandas has no null integers
    out = freeze(placed.mapInPandas(_stream, f"id string, {_SCHEMA}, _edge int, _pid int, _text string"), "fingerprints")
    pids = sorted(r["_pid"] for r in out.where("_edge = 0").select("_pid").collect())  # one number a partition
    follows = docs.sparkSession.createDataFrame(list(zip(pids, pids[1:] + pids[:1])), "_pid int, _next int")
    last = out.where("_edge = 1").select("id", "_pid", F.col("_text").alias("text"), F.col("fingerprint").alias("mark"))
    first = out.where("_edge = 0").select(F.col("_pid").alias("_next"), F.col("_text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    met = last.join(F.broadcast(follows), "_pid").join(first, "_next").select("id", "text", "mark", "next_text", "next_mark")
    met = met.mapInPandas(_meet, f"id string, {_SCHEMA}")
    both = out.where("_edge = -1").select(met.columns).unionByName(met)
    return both.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and their edited texts."""
    return fingerprint(table(spark, sf_dir, "documents"))
