"""Language-model scores by stupid backoff, computed relationally.

Words are lower-cased runs of word characters; n-grams of 1 to ORDER words are 64-bit hashes. A word's score is the
count of its longest n-gram that other documents hold, over the count of that n-gram's context, times ALPHA for each
order given up; the counts are those of the whole corpus less the document's own. A document's score is the sum of the
logarithms over its words.

The exploded n-grams are kept column by column: a chunk of documents has one row, a blob, for each hash range and order,
with the sorted distinct hashes and their counts in the chunk, so a frequent n-gram is one entry a chunk. They are
shuffled by range once, summed to the count table and joined back in one step, and return to their chunk as totals alone.
The chunks lie in a table bucketed by chunk, so that this last join moves only the totals.

A chunk has at most FAN blobs, however large the corpus, so rows grow with n-grams. Where FAN ranges are too large for a
task, the blobs of FAN chunks in a range are merged, summed and cut again into FAN ranges, and so on until ranges are
small; the totals come back by the same way. A task holds a chunk's n-grams or a small range's.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylume.llm.common import delete, freeze, shared_dir, table, tidy
from querylume.llm.ngram_join import _WORD, _mix, _WordHash

ORDER = 3
ALPHA = 0.4
#: Words in a chunk, unless a single document has more; n-grams (distinct in their chunk) in a hash partition.
CHUNK_WORDS = 1_500_000
PARTITION_GRAMS = 2_000_000
#: Blobs of a chunk, or of merged chunks, and chunks that are merged.
FAN = 512
_SLICE_WORDS = 250_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned integers, the bytes of like place together, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to chunks: ids, words per document, the chunk's vocabulary as hashes and its words as places in it."""
    hashes, task = _WordHash(), TaskContext.get().partitionId()
    ids, lens, parts, total, number, kind = [], [], [], 0, 0, None

    def row() -> pa.RecordBatch:
        vocabulary, codes = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True)
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([task << 32 | number], pa.int64()), "ids": pa.array([ids], pa.list_(kind)), "lens": pa.array([lens], pa.list_(pa.int64())),
            "vocabulary": pa.array([vocabulary.astype("<u8").tobytes()], pa.binary()), "codes": pa.array([codes.astype("<u4").tobytes()], pa.binary()),
        })

    for batch in batches:
        kind = batch.schema.field("id").type
        for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            words = _WORD.findall(text.as_py().lower()) if text.is_valid else []
            if ids and total + len(words) > CHUNK_WORDS:
                yield row()
                ids, lens, parts, total, number = [], [], [], 0, number + 1
            ids.append(id_)
            lens.append(len(words))
            total += len(words)
            parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
    if ids:
        yield row()


def _grams(vocabulary: bytes, codes: bytes, lens: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: the hashes of the n-grams, and the places of their last words."""
    words = np.frombuffer(vocabulary, "<u8")[np.frombuffer(codes, "<u4")].astype(np.uint64)
    within = np.arange(len(words)) - np.repeat(np.cumsum(lens) - lens, lens)
    h = np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        h = words.copy() if n == 1 else np.append(np.zeros(min(1, len(h)), np.uint64), h[:-1]) * _FACTOR + words
        at = np.flatnonzero(within >= n - 1)
        yield _mix(h[at] + np.uint64(n)), at


_BLOB = "owner long, span long, n int, keys binary, counts binary"


def _cut(keys: np.ndarray, counts: np.ndarray, first: int, fan: int, spans: int) -> Iterator[tuple[int, bytes, bytes]]:
    """The part of sorted hashes in each of the ``fan`` spans from ``first`` on, of ``spans`` that the hashes have in all;
    only spans that hold any."""
    edges = np.array([(p << 64) // spans for p in range(first, first + fan)], np.uint64)
    cuts = np.append(np.searchsorted(keys, edges), len(keys))
    for i in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[i], cuts[i + 1])
        yield first + int(i), _pack(np.diff(keys[part], prepend=np.uint64(0))), _pack(counts[part])


def _explode(order: int, fan: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                for n, (h, _) in enumerate(_grams(r["vocabulary"], r["codes"], np.asarray(r["lens"], np.int64), order), 1):
                    found = list(_cut(*np.unique(h, return_counts=True), 0, fan, fan))
                    yield pa.RecordBatch.from_pydict({
                        "owner": pa.array([r["chunk"]] * len(found), pa.int64()), "span": pa.array([x[0] for x in found], pa.int64()), "n": pa.array([n] * len(found), pa.int32()),
                        "keys": pa.array([x[1] for x in found], pa.binary()), "counts": pa.array([x[2] for x in found], pa.binary()),
                    })

    return run


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of blobs of one order: the distinct hashes, their summed counts, each blob's places in them, and the blobs' ends."""
    keys = [np.cumsum(_unpack(k), dtype=np.uint64) for k in pdf["keys"]]
    distinct, inv = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unpack(c) for c in pdf["counts"]])
    return distinct, np.bincount(inv, counts.astype(np.float64)).astype(np.uint64), inv, np.cumsum([len(k) for k in keys])


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """One span: the count table, joined back to the owners' n-grams."""
    out = []
    for n, part in pdf.groupby("n"):
        _, totals, inv, ends = _summed(part)
        out.append(pd.DataFrame({"owner": part["owner"], "span": part["span"], "n": n, "totals": [_pack(t) for t in np.split(totals[inv], ends[:-1])]}))
    return pd.concat(out)


def _merge(fan: int, spans: int):
    """The blobs of a group of owners in one span, as the blobs of one owner in ``fan`` smaller spans."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        span, group = key
        rows = []
        for n, part in pdf.groupby("n"):
            keys, counts, _, _ = _summed(part)
            rows += [(group, at, n, k, c) for at, k, c in _cut(keys, counts, span * fan, fan, spans * fan)]
        return pd.DataFrame(rows, columns=["owner", "span", "n", "keys", "counts"])

    return run


def _spread(blobs: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """The totals of a group of owners in one span, dealt to the owners' blobs."""
    out = []
    for n, part in blobs.groupby("n"):
        keys, _, inv, ends = _summed(part)
        found = np.concatenate([_unpack(t) for t in totals[totals["n"] == n].sort_values("span")["totals"]])
        if len(found) != len(keys):
            raise ValueError("totals don't fit their group")
        out.append(pd.DataFrame({"owner": part["owner"], "span": part["span"], "n": n, "totals": [_pack(t) for t in np.split(found[inv], ends[:-1])]}))
    return pd.concat(out)


def _totals(blobs: DataFrame, spans: int, owners: int, wanted: int, fan: int) -> DataFrame:
    """owner, span, n, totals: for each blob the counts of its hashes over all owners. ``spans`` are those of the blobs,
    ``owners`` how many a span may have, ``wanted`` the spans of which one fits a task."""
    schema = "owner long, span long, n int, totals binary"
    if spans >= wanted:
        return blobs.groupBy("span").applyInPandas(_sum, schema)
    blobs = freeze(blobs, "lm-blobs")
    groups = -(-owners // fan)
    grouped = blobs.withColumn("group", F.pmod(F.xxhash64("owner"), F.lit(groups)).cast("long"))
    below = grouped.groupBy("span", "group").applyInPandas(_merge(fan, spans), _BLOB)
    found = _totals(below, spans * fan, groups, wanted, fan)
    found = found.select(F.floor(F.col("span") / fan).cast("long").alias("above"), F.col("owner").alias("group"), "span", "n", "totals")
    met = grouped.groupBy("span", "group").cogroup(found.groupBy("above", "group"))
    return met.applyInPandas(_spread, schema)


def _others(r: dict, n: int, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Counts of n-grams ``h`` in other documents than their own. One sort by hash, which keeps documents in order, puts
    equal n-grams together, and those of a document among them."""
    found = [_unpack(t["totals"]) for t in sorted((t for t in r["got"] if t["n"] == n), key=lambda t: t["span"])]
    got = np.concatenate(found) if found else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.append(True, h[1:] != h[:-1])[: len(h)]  # of each distinct n-gram
    if np.count_nonzero(first) != len(got):
        raise ValueError("totals don't fit their chunk")
    own = np.flatnonzero(first | np.append(True, doc[1:] != doc[:-1])[: len(h)])  # where an n-gram's run in a document begins
    counts = got.astype(np.float64)[np.cumsum(first) - 1] - np.repeat(np.diff(np.append(own, len(h))), np.diff(np.append(own, len(h))))
    out = np.empty(len(h))
    out[order] = counts
    return out


def _score(order: int, alpha: float, words_in_all: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                lens = np.asarray(r["lens"], np.int64)
                doc = np.repeat(np.arange(len(lens)), lens)
                total = len(doc)
                seen = np.full((order, total), -1.0)  # of the n-gram that ends here, in other documents; -1: none ends here
                for n, (h, at) in enumerate(_grams(r["vocabulary"], r["codes"], lens, order)):
                    seen[n, at] = _others(r, n + 1, h, doc[at])
                out, at = np.zeros(len(lens)), 0
                while at < total:
                    to = int(np.searchsorted(doc, doc[min(at + _SLICE_WORDS, total) - 1], side="right"))
                    out += np.bincount(doc[at:to], _logs(seen[:, at:to], (words_in_all - lens[doc[at:to]]).astype(np.float64), alpha), len(lens))
                    at = to
                yield pa.RecordBatch.from_pydict({"id": batch.column("ids")[i].values, "n_words": pa.array(lens, pa.int64()), "score": pa.array(out, pa.float64())})

    return run


def _logs(seen: np.ndarray, others: np.ndarray, alpha: float) -> np.ndarray:
    """The logarithm of each word's score, for whole documents."""
    out, penalty = np.full(seen.shape[1], np.nan), np.zeros(seen.shape[1])
    for n in range(len(seen) - 1, 0, -1):
        context = np.append(0.0, seen[n - 1, :-1])[: seen.shape[1]]
        use = np.isnan(out) & (seen[n] > 0)
        out[use] = np.log(seen[n, use] / context[use]) + penalty[use]
        penalty += np.where(seen[n] >= 0, math.log(alpha), 0.0)
    use = np.isnan(out)
    out[use] = np.log(np.where(seen[0, use] > 0, seen[0, use] / np.maximum(others[use], 1), 1 / (others[use] + 1))) + penalty[use]
    return out


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, partition_grams: int = PARTITION_GRAMS, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, score (sum of natural logarithms), mean_score (per word).

    A null text, or one without words, has n_words 0, score 0 and mean_score null. A word that no other document holds
    counts as once in one word more than theirs. Rows that repeat are documents of their own. Other columns are ignored.
    An empty table gives an empty result."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    name = f"lm_chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        cut = rows.mapInArrow(_chunks, f"chunk long, ids array<{kind}>, lens array<long>, vocabulary binary, codes binary")
        cut.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "chunk").saveAsTable(name)
        chunks = spark.table(name)
        n_chunks, words = chunks.agg(F.count("*"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        words = words or 0
        wanted = max(buckets, math.ceil(words * order / partition_grams))
        first = min(wanted, fan)
        blobs = chunks.select("chunk", "lens", "vocabulary", "codes").mapInArrow(_explode(order, first), _BLOB)
        totals = _totals(blobs, first, n_chunks, wanted, fan)
        back = totals.groupBy(F.col("owner").alias("chunk")).agg(F.collect_list(F.struct("n", "span", "totals")).alias("got"))  # at most order x fan
        met = chunks.join(back, "chunk", "left").withColumn("got", F.coalesce("got", F.array().cast("array<struct<n:int,span:bigint,totals:binary>>")))
        scored = freeze(met.mapInArrow(_score(order, alpha, words), f"id {kind}, n_words long, score double"), "lm-scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)
    mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), "n_words", "score", mean.alias("mean_score"))


def op5_backoff_lm(spark, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all ``documents``: doc_id, n_words, score, mean_score."""
    return backoff_scores(table(spark, sf_dir, "documents"))
