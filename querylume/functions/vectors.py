"""Embeddings, cosine similarity and exact nearest neighbours.

Few queries are sent to every task. Many meet the items by pivots: a bounded number of items, drawn by a hash of their ids.
Every item belongs to its nearest pivot, and a pivot's items are cut into blocks by their distance from it. A query first
meets the block of its own pivot that is as far from the pivot as it is, which gives a bound for its k-th best score. By the
triangle inequality a block whose items are between lo and hi from their pivot is at least as far from a query as the
query's distance from that pivot lies outside of lo to hi; only blocks within the bound are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querylume.operators.storage import frozen, numbered

DIMENSIONS = 64
_BLOCK = 512
#: Queries of up to so many vectors are sent to every task; more meet the items by pivots.
MAX_BROADCAST = 50_000
#: Pivots at most, and items for each; items of a block; queries that meet a block together.
PIVOTS, PER_PIVOT, ITEMS, QUERIES = 256, 64, 4096, 4096
_SLACK = 1e-9  # rounding never rules out a block


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column | str) -> Column:
    """The vector in double precision, of length 1; zeros stay zeros. The product of two is their cosine."""
    norms = F.array_repeat(F.sqrt(dot(a, a)), F.size(a))  # as an argument the norm is taken once a vector, in the function once a number
    return F.zip_with(a, norms, lambda x, n: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The offline stand-in for a sentence encoder: words and their character trigrams counted in md5 buckets."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    tri = F.flatten(F.transform(w, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.concat(F.lit("#"), F.substring(x, i, F.lit(3))))))
    bucket = lambda x: (F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    found = F.array(F.transform(F.concat(w, w, tri), bucket))
    # bound to a name, the buckets are found once a text, not once a bucket; what a bucket's removal takes away is its count
    count = lambda f: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (F.size(f) - F.size(F.array_remove(f, i))).cast("float"))
    return F.transform(found, count)[0]


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, grp, ord, emb) to blocks of unit vectors."""
    for pdf in batches:
        for at in range(0, len(pdf), _BLOCK):
            part = pdf.iloc[at : at + _BLOCK]
            m = np.vstack(part["emb"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "grp": [part["grp"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()], "d": [m.shape[1]]})


def top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(id, grp, emb) x (id, grp, emb) to each query's k most similar other items: q_id, q_grp, id, grp, score, rank.

    Exact, in blocks: both sides are packed to blocks of unit vectors, every pair of blocks is one matrix product, and a
    pair passes on k rows a query, so the shuffle holds k rows for each query and block of items, whatever the scores.
    Ties go to the smaller id. More than MAX_BROADCAST queries meet the items by pivots."""
    if queries.limit(MAX_BROADCAST + 1).count() > MAX_BROADCAST:
        return top_k_by_pivots(queries, items, k)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q, x = (np.frombuffer(b).reshape(-1, r.d) for b in (r.q_m, r.m))
                qi, qg, ids, grp = (np.frombuffer(b, np.int64) for b in (r.q_ids, r.q_grp, r.ids, r.grp))
                order = np.argsort(ids, kind="stable")
                ids, grp, score = ids[order], grp[order], np.round(q @ x[order].T, 12)
                score[qi[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(qi)), best.shape[1])
                out = pd.DataFrame({"q_id": qi[rows], "q_grp": qg[rows], "id": ids[best.ravel()], "grp": grp[best.ravel()], "score": score[rows, best.ravel()]})
                yield out[np.isfinite(out["score"])]

    packed = "ids binary, grp binary, m binary, d int"
    q = queries.select("id", "grp", "emb").mapInPandas(_pack, packed).withColumnsRenamed({"ids": "q_ids", "grp": "q_grp", "m": "q_m"}).drop("d")
    x = items.select("id", "grp", "emb").mapInPandas(_pack, packed)
    pairs = x.crossJoin(F.broadcast(q))  # blocks, not rows; counted above
    met = pairs.mapInPandas(meet, "q_id long, q_grp long, id long, grp long, score double")
    at = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", at).where(F.col("rank") <= k)


_PLACED = "id long, grp long, emb array<double>, pivot int, dist double"


def _units(batch: pa.RecordBatch) -> np.ndarray:
    emb = batch.column("emb")
    m = emb.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(emb), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _far(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots, without the loss of small ones that a product of norms has."""
    out = np.empty((len(m), len(pivots)))
    for i, p in enumerate(pivots):
        out[:, i] = np.linalg.norm(m - p, axis=1)
    return out


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)[: len(m) + 1], m.ravel())


def _by_nearest(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (id, grp, emb) as unit vectors with their nearest pivot and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _units(batch)
            far = _far(m, pivots)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), _lists(m), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(m)), near])], ["id", "grp", "emb", "pivot", "dist"])

    return df.select("id", "grp", "emb").where("emb is not null").mapInArrow(run, _PLACED)


def _products(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Queries (q_id, q_grp, q_emb, block) and items (id, grp, emb, block) to each query's k best of each of its blocks. A
    block with many queries is copied for each part of them."""
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("_parts"))
    left = asked.join(parts, "block").withColumn("_part", F.pmod(F.xxhash64("q_id"), "_parts")).drop("_parts")
    right = blocks.select("id", "grp", "emb", "block").join(parts, "block").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts").withColumnRenamed("block", "_of")
    right = right.toDF(*right.columns)
    names = ["q_id", "q_grp", "id", "grp", "score"]

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        out = [pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in names})]
        if some.num_rows and others.num_rows:
            others = others.sort_by("id").combine_chunks()
            matrix = lambda t, c: pa.concat_arrays(t.column(c).chunks).flatten().to_numpy().reshape(t.num_rows, -1)
            x, ids, grp = matrix(others, "emb"), others.column("id").to_numpy(), others.column("grp").to_numpy()
            for at in range(0, some.num_rows, _BLOCK):
                part = some.slice(at, _BLOCK)
                qi, qg = part.column("q_id").to_numpy(), part.column("q_grp").to_numpy()
                score = np.round(matrix(part, "q_emb") @ x.T, 12)
                score[qi[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                rows, best = np.repeat(np.arange(len(qi)), best.shape[1]), best.ravel()
                good = np.isfinite(score[rows, best])
                rows, best = rows[good], best[good]
                out.append(pa.table([qi[rows], qg[rows], ids[best], grp[best], score[rows, best]], names=names))
        return pa.concat_tables(out)

    return left.groupBy("block", "_part").cogroup(right.groupBy("_of", "_copy")).applyInArrow(meet, "q_id long, q_grp long, id long, grp long, score double")


def top_k_by_pivots(queries: DataFrame, items: DataFrame, k: int, pivots: int | None = None) -> DataFrame:
    """As ``top_k``: exact, with blocks left out that can't hold any of a query's k best."""
    if pivots is None:
        pivots = min(PIVOTS, items.limit(PIVOTS * PER_PIVOT).count() // PER_PIVOT + 1)
    drawn = items.where("emb is not null").orderBy(F.xxhash64("id"), "id").select("emb").limit(pivots).collect()  # at most ``pivots`` vectors
    if not drawn:
        return queries.where("false").select(F.col("id").alias("q_id"), F.col("grp").alias("q_grp"), "id", "grp", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    centres = np.array([r["emb"] for r in drawn], np.float64)
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.divide(centres, norm, out=np.zeros_like(centres), where=norm > 0)
    placed = numbered(_by_nearest(items, centres), "place", "pivot", "dist", "id", what="pivot-items")
    block = F.struct("pivot", F.floor(F.col("place") / ITEMS).alias("at"))
    blocks = placed.withColumn("block", block)
    rings = frozen(blocks.groupBy("block").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).withColumn("pivot", F.col("block.pivot")), "pivot-rings")
    asked = frozen(_by_nearest(queries, centres).withColumnsRenamed({"id": "q_id", "grp": "q_grp", "emb": "q_emb"}), "pivot-queries")
    outside = F.greatest(F.lit(0.0), F.col("lo") - F.col("dist"), F.col("dist") - F.col("hi"))
    nearest = asked.select("q_id", "pivot", "dist").join(rings, "pivot").groupBy("q_id").agg(F.min_by("block", F.struct(outside, "block")).alias("block"))
    first = frozen(_products(asked.select("q_id", "q_grp", "q_emb").join(nearest, "q_id"), blocks, k), "pivot-first")
    bounds = nearest.join(first.groupBy("q_id").agg(F.count("*").alias("n"), F.min("score").alias("score")), "q_id", "left")
    bounds = bounds.select("q_id", F.col("block").alias("seen"), F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) + _SLACK).otherwise(F.lit(3.0)).alias("reach"))  # no distance is over 2
    ranges = {r["pivot"]: (r["lo"], r["hi"]) for r in rings.groupBy("pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # a row a pivot
    held = np.array(sorted(ranges))
    lows, highs = (np.array([ranges[p][i] for p in held]) for i in (0, 1))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("q_emb").flatten().to_numpy().reshape(batch.num_rows, -1)
            far, reach = _far(m, centres[held]), batch.column("reach").to_numpy()[:, None]
            q, p = np.nonzero((far >= lows - reach) & (far <= highs + reach))
            yield pa.RecordBatch.from_arrays([batch.column("q_id").take(pa.array(q)), pa.array(held[p].astype(np.int32)), pa.array(far[q, p])], ["q_id", "pivot", "dist"])

    known = asked.select("q_id", "q_emb").join(bounds.select("q_id", "reach"), "q_id")
    near = known.mapInArrow(reached, "q_id long, pivot int, dist double").join(rings, "pivot").join(bounds, "q_id")
    more = near.where((outside <= F.col("reach")) & (F.col("block") != F.col("seen"))).select("q_id", "block")
    second = _products(asked.select("q_id", "q_grp", "q_emb").join(more, "q_id"), blocks, k)
    at = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "id"))
    return first.unionByName(second).withColumn("rank", at).where(F.col("rank") <= k)


def rank_within(scored: DataFrame, keys: list[str], k: int, ties: list[str]) -> DataFrame:
    """The k best rows by score of each key; k of 0 or less keeps all."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), *ties))
    out = scored.withColumn("rank", at)
    return out.where(F.col("rank") <= k) if k > 0 else out
