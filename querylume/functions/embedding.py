"""Word vectors learned from a corpus: how often words stand near each other, as positive pointwise mutual information, factored
by a randomised decomposition whose products are Spark jobs.

Counts cover all documents. The vocabulary is the VOCABULARY most frequent words, and its most frequent CONTEXTS are what
words are counted beside, so the matrix has at most one row a word, each no longer than CONTEXTS, and lies in the shared
folder. A task multiplies its rows with a block of CONTEXTS x rank numbers, and gives one such block back; the driver adds
PARTS of them, makes them orthogonal, and sends the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querylume.functions.vectors import DIMENSIONS, hashed_embedding
from querylume.operators.storage import frozen, thaw

VOCABULARY, CONTEXTS, WINDOW = 20_000, 2048, 2
#: Further columns of the block, and rounds, that make the decomposition good; tasks of a product.
MORE, ROUNDS, PARTS = 8, 6, 16
_TEXTS = 512  # texts whose pairs are found together


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def vocabulary_of(docs: DataFrame, text_col: str = "text", most: int = VOCABULARY) -> DataFrame:
    """word, n, at: the most frequent words, by count and then by name, numbered from 0."""
    counts = docs.select(F.explode(words_of(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(most)  # at most VOCABULARY rows
    return top.withColumn("at", F.row_number().over(W.orderBy(F.desc("n"), "word")) - 1)


def information(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text", contexts: int = CONTEXTS, window: int = WINDOW) -> DataFrame:
    """a, b, ppmi: for a word and a context that stand within ``window`` of each other more often than their counts say."""
    held = pa.array([r["word"] for r in vocabulary.select("word", "at").orderBy("at").collect()], pa.string())  # at most VOCABULARY

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, _TEXTS):
                texts = batch.column("w").slice(at, _TEXTS)
                code = pc.index_in(texts.flatten(), held).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                text = pc.list_parent_indices(texts).to_numpy()
                for o in range(1, window + 1):
                    x, y = code[:-o], code[o:]
                    near = (text[:-o] == text[o:]) & (x >= 0) & (y >= 0)
                    x, y = x[near], y[near]
                    found += [(x * len(held) + y)[y < contexts], (y * len(held) + x)[x < contexts]]
            cells, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            size = max(1, len(held))
            yield pa.RecordBatch.from_arrays([pa.array((cells // size).astype(np.int32)), pa.array((cells % size).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    # a task turns words into their numbers and counts pairs of numbers, so no row stands for a place in a text
    both = docs.select(words_of(F.col(text_col)).alias("w")).where("w is not null").mapInArrow(pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = frozen(both, "word-pairs")
    total = both.agg(F.sum("n")).first()[0] or 0
    side = lambda c, name: F.broadcast(both.groupBy(c).agg(F.sum("n").alias(name)))  # noqa: E731  a row a word
    ratio = F.log(F.col("n") * F.lit(float(total)) / (F.col("_a").cast("double") * F.col("_b")))
    out = both.join(side("a", "_a"), "a").join(side("b", "_b"), "b").select("a", "b", ratio.alias("ppmi")).where("ppmi > 0")
    out._frozen_at = both._frozen_at
    return out


def _product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The transposed matrix times the matrix times the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(block.shape)
        for batch in batches:
            for b, x in zip(batch.column("b"), batch.column("x")):
                at, values = b.values.to_numpy(), x.values.to_numpy()
                out[at] += values[:, None] * (values @ block[at])
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "sums": [out.tobytes()]}, schema=pa.schema([("part", pa.int32()), ("sums", pa.binary())]))

    found = rows.mapInArrow(run, "part int, sums binary").collect()  # a block a task, of which there are about PARTS
    return sum((np.frombuffer(r["sums"]).reshape(block.shape) for r in sorted(found, key=lambda r: r["part"])), np.zeros(block.shape))


def learn(docs: DataFrame, text_col: str = "text", dimensions: int = DIMENSIONS, vocabulary: int = VOCABULARY, contexts: int = CONTEXTS, window: int = WINDOW, seed: int = 0, words: DataFrame | None = None) -> DataFrame:
    """word, vector: the left singular vectors, each times the root of its singular value, of the words that have any
    information. The largest number of a right singular vector is positive, so a run gives what another gave. Null texts
    don't count. Vectors have fewer dimensions only where there are fewer contexts. ``words`` is the vocabulary, if it is
    known."""
    if words is None:
        words = frozen(vocabulary_of(docs, text_col, vocabulary), "vocabulary")
    cells = information(docs, words, text_col, contexts, window)
    packed = cells.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", F.col("ppmi").alias("x")))).alias("c"))  # at most CONTEXTS
    rows = frozen(packed.select("a", F.transform("c", lambda c: c["b"]).alias("b"), F.transform("c", lambda c: c["x"]).alias("x")).repartitionByRange(PARTS, "a").sortWithinPartitions("a"), "word-rows")
    thaw(cells)
    n = min(contexts, words.count())
    rank = min(n, dimensions)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, dimensions + MORE))))[0] if n else np.zeros((0, 0))
    for _ in range(ROUNDS if n else 0):
        block = np.linalg.qr(_product(rows, block))[0]
    values, turn = np.linalg.eigh(block.T @ _product(rows, block)) if n else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values)[:rank]
    right = block @ turn[:, order]
    right *= np.where(right[np.abs(right).argmax(axis=0), np.arange(right.shape[1])] < 0, -1.0, 1.0) if n else 1.0
    size = np.sqrt(np.sqrt(np.maximum(values[order], 1e-30)))  # the root of the singular value

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x.values.to_numpy() @ right[b.values.to_numpy()] / size for b, x in zip(batch.column("b"), batch.column("x"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array([v.astype(np.float32) for v in made], pa.list_(pa.float32()))], ["a", "vector"])

    found = rows.mapInArrow(project, "a int, vector array<float>")
    return words.join(found, words["at"] == found["a"]).select("word", "vector")


def embedder(vectors: DataFrame, other: Callable[[Column], Column] | None = hashed_embedding) -> Callable[[Column], Column]:
    """For ``Config.embed``: a text's known words' vectors, added and brought to length 1, and beside them, also of length
    1, what ``other`` makes of the text, so that texts without known words have a vector too. The words, at most VOCABULARY,
    go with the task."""
    rows = vectors.orderBy("word").collect()  # at most VOCABULARY
    at = {r["word"]: i for i, r in enumerate(rows)}
    held = np.array([r["vector"] for r in rows], np.float32).reshape(len(rows), -1)

    @F.pandas_udf("array<float>")
    def added(words: pd.Series) -> pd.Series:
        out = []
        for ws in words:
            found = [at[w] for w in (ws if ws is not None else ()) if w in at]
            v = held[found].sum(axis=0) if found else np.zeros(held.shape[1], np.float32)
            length = float(np.linalg.norm(v))
            out.append(v / np.float32(length) if length else v)
        return pd.Series(out)

    def embed(text: Column) -> Column:
        own = added(words_of(text))
        if other is None:
            return own
        bag = other(text)
        norm = F.array_repeat(F.sqrt(F.aggregate(bag, F.lit(0.0), lambda s, x: s + x * x)), F.size(bag))
        return F.concat(own, F.zip_with(bag, norm, lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0)).cast("float")))

    return embed
