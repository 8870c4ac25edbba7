"""Schema linking: phrases and schema elements meet in blocks and leave as tables, columns and few-shot examples.

Similarity is a block product. The phrases of a database are dealt into parts, whatever question they come from, and its
elements into blocks; a group is one part and one block, and multiplies their matrices. What leaves a group is the k best
elements of each phrase, or the k best tables of each question, so no row stands for a pair, and a database that holds all
questions is spread over as many tasks as its phrases need. Only where all elements are asked for, all pairs leave, and groups
are smaller. The k best of parts hold the k best of all: whatever beats an
element within its part also beats it in the end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querylume.functions.vectors import rank_within

THRESHOLD = 0.35
#: Phrases and elements that a group holds on average, and phrases that are multiplied at a time.
PHRASES, ELEMENTS, SLICE = 8192, 4096, 1024
#: The same where all pairs leave a group, which then holds a row for each.
ALL_PHRASES, ALL_ELEMENTS = 256, 1024
EVERYTHING = 2**31 - 1


def _matrix(rows: pa.Table) -> np.ndarray:
    """Unit vectors of the column emb, in double precision; zeros stay zeros."""
    emb = pa.concat_arrays(rows.column("emb").chunks)
    m = emb.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(emb), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal values alike, and the values by number."""
    found = pa.concat_arrays(values.chunks).dictionary_encode("encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, the first of equal ones; none of -inf."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(scores)), order.shape[1])
    good = np.isfinite(scores[rows, order.ravel()])
    return rows[good], order.ravel()[good]


def _meet(phrases: DataFrame, elements: DataFrame, kernel: Callable, schema: str, everything: bool = False) -> DataFrame:
    """``kernel`` of each group's phrases and elements, the elements sorted by ord. Rows without a vector are left out."""
    phrases, elements = phrases.where("emb is not null"), elements.where("emb is not null")
    count = lambda df, most: F.ceil(F.count("*") / most)
    a_part, a_block = (ALL_PHRASES, ALL_ELEMENTS) if everything else (PHRASES, ELEMENTS)
    sizes = phrases.groupBy("db_id").agg(count(phrases, a_part).alias("_parts")).join(elements.groupBy("db_id").agg(count(elements, a_block).alias("_blocks")), "db_id")
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = phrases.join(sizes, "db_id").withColumns({"_part": F.pmod(F.xxhash64("q_id", "phrase"), "_parts"), "_block": copies("_blocks")}).drop("_parts", "_blocks")
    blocks = elements.join(sizes, "db_id").withColumns({"_at": copies("_parts"), "_of": F.pmod(F.xxhash64("name", "ord"), "_blocks")}).drop("_parts", "_blocks").withColumnRenamed("db_id", "_db")
    blocks = blocks.toDF(*blocks.columns)  # names of its own, where both sides come from one table

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        out = []
        if some.num_rows and others.num_rows:
            others = others.sort_by([("ord", "ascending")])
            right = _matrix(others)
            for at in range(0, some.num_rows, SLICE):
                part = some.slice(at, SLICE).combine_chunks()
                scores = np.round(_matrix(part) @ right.T, 9)
                if "self" in part.column_names:
                    scores[part.column("self").to_numpy()[:, None] == others.column("self").to_numpy()[None, :]] = -np.inf
                out.append(kernel(part, others, scores))
        return pa.concat_tables(out) if out else kernel(some.slice(0, 0), others.slice(0, 0), np.zeros((0, 0)))

    return dealt.groupBy("db_id", "_part", "_block").cogroup(blocks.groupBy("_db", "_at", "_of")).applyInArrow(run, schema)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def candidate_tables(phrases: DataFrame, elements: DataFrame, k: int) -> DataFrame:
    """The k tables with the highest similarity to any of a question's phrases; all for k = 0: q_id, db_id, name, score,
    ord, rank. Phrases have (q_id, db_id, phrase, emb), elements (db_id, name, ord, emb), of a name with
    several vectors one each, all with its ord. A phrase doesn't meet an element with its value of ``self``, where both have that column. Equal
    scores go by ord."""

    def kernel(part: pa.Table, others: pa.Table, scores: np.ndarray) -> pa.Table:
        asked, questions = _codes(part.column("q_id")) if part.num_rows else (np.zeros(0, np.int64), part.column("q_id").combine_chunks())
        named, names = _codes(others.column("name")) if others.num_rows else (np.zeros(0, np.int64), others.column("name").combine_chunks())
        ords = others.column("ord").to_numpy()
        if len(asked):
            by = np.argsort(named, kind="stable")  # names are numbered as they come, by their least ord
            scores = np.maximum.reduceat(scores[:, by], np.searchsorted(named[by], np.arange(len(names))), axis=1)
            ords = ords[by][np.searchsorted(named[by], np.arange(len(names)))]
            by = np.argsort(asked, kind="stable")
            scores = np.maximum.reduceat(scores[by], np.searchsorted(asked[by], np.arange(len(questions))), axis=0)
        q, n = _best(scores, k if k > 0 else max(scores.shape[1], 1)) if len(asked) else (asked, named)
        db = part.column("db_id").combine_chunks()
        return pa.table({"q_id": questions.take(pa.array(q)), "db_id": db.take(pa.array(np.zeros(len(q), np.int64))) if len(q) else db.slice(0, 0), "name": names.take(pa.array(n)), "ord": pa.array(ords[n].astype(np.int64)), "score": pa.array(scores[q, n] if len(q) else np.zeros(0))})

    schema = f"q_id {_kind(phrases, 'q_id')}, db_id {_kind(phrases, 'db_id')}, name {_kind(elements, 'name')}, ord long, score double"
    keep = [c for c in ("q_id", "db_id", "phrase", "self", "emb") if c in phrases.columns]
    met = _meet(phrases.select(*keep), elements.select(*[c for c in ("db_id", "name", "ord", "self", "emb") if c in elements.columns]), kernel, schema)
    best = met.groupBy("q_id", "db_id", "name").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))
    return rank_within(best, ["q_id"], k, ["ord"])


def nearest(phrases: DataFrame, elements: DataFrame, k: int, tables: DataFrame | None = None, cuts: tuple[int, ...] = (EVERYTHING,)) -> DataFrame:
    """The k elements most similar to each phrase; all for k = 0: cut, q_id, db_id, phrase, table, name, ord, score, rank.
    Elements have (db_id, table, name, ord, emb). With ``tables`` (q_id, name, rank) a question's phrases only meet elements
    of its tables, for each of ``cuts`` of those whose rank isn't above it. ``self`` and ties are as for tables."""
    limited = tables is not None
    if limited:
        own = tables.groupBy("q_id").agg(F.collect_list(F.struct(F.col("name").alias("table"), F.col("rank").cast("int").alias("rank"))).alias("tables"))
        phrases = phrases.join(own, "q_id")

    def kernel(part: pa.Table, others: pa.Table, scores: np.ndarray) -> pa.Table:
        found = []
        if part.num_rows and others.num_rows:
            ranks = np.zeros(scores.shape, np.int64)
            if limited:
                held = pa.concat_arrays(part.column("tables").chunks)
                at, of = pc.list_parent_indices(held).to_numpy(), held.flatten()
                codes, known = _codes(others.column("table"))
                code = pc.index_in(of.field("table"), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                by_table = np.full((part.num_rows, len(known)), EVERYTHING + 1, np.int64)
                there = code >= 0
                by_table[at[there], code[there]] = of.field("rank").to_numpy(zero_copy_only=False)[there]
                ranks = by_table[:, codes]
            for cut in cuts:
                allowed = np.where(ranks <= cut, scores, -np.inf)
                p, e = _best(allowed, k) if k > 0 else np.nonzero(np.isfinite(allowed))
                found.append((np.full(len(p), cut), p, e))
        cut, p, e = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        left, right = part.take(pa.array(p, pa.int64())), others.take(pa.array(e, pa.int64()))
        return pa.table({"cut": pa.array(cut.astype(np.int32)), **{c: left.column(c) for c in ("q_id", "db_id", "phrase")}, **{c: right.column(c) for c in ("table", "name")}, "ord": right.column("ord").cast(pa.int64()), "score": pa.array(scores[p, e] if len(p) else np.zeros(0))})

    kinds = ", ".join(f"{c} {_kind(df, c)}" for df, cs in ((phrases, ("q_id", "db_id", "phrase")), (elements, ("table", "name"))) for c in cs)
    keep = [c for c in ("q_id", "db_id", "phrase", "self", "tables", "emb") if c in phrases.columns]
    met = _meet(phrases.select(*keep), elements.select(*[c for c in ("db_id", "table", "name", "ord", "self", "emb") if c in elements.columns]), kernel, f"cut int, {kinds}, ord long, score double", k <= 0)
    return rank_within(met, ["cut", "q_id", "phrase"], k, ["ord"])


def candidate_columns(phrases: DataFrame, elements: DataFrame, tables: DataFrame, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """Columns of candidate tables: each phrase's k best, or for k = 0 its best if that scores above the threshold;
    united over phrases: q_id, db_id, table, name, score."""
    top = nearest(phrases, elements, max(k, 1), tables)
    if k <= 0:
        top = top.where(F.col("score") > threshold)
    return top.groupBy("q_id", "db_id", "table", "name").agg(F.max("score").alias("score"))


def same_group_first(ranked: DataFrame, k: int) -> DataFrame:
    """Of each query's ranked pool (q_id, q_grp, grp, rank) the first k, those of its own group first, each part in rank
    order: adds place."""
    at = F.row_number().over(W.partitionBy("q_id").orderBy((F.col("q_grp") != F.col("grp")).cast("int"), "rank"))
    return ranked.withColumn("place", at).where(F.col("place") <= k)


def recall_precision(gold: DataFrame, retrieved: DataFrame, column_mode: bool = True) -> DataFrame:
    """(q_id, elements array) twice to q_id, recall, precision. No gold elements: (1, 1). Nothing retrieved: precision 0,
    and in table mode recall 0 too."""
    met = gold.select("q_id", F.col("elements").alias("g")).join(retrieved.select("q_id", F.col("elements").alias("r")), "q_id", "left")
    r = F.coalesce("r", F.array().cast("array<string>"))
    hit = F.size(F.array_intersect("g", r)).cast("double")
    none = F.size("g") == 0
    recall = F.when(none, 1.0).when(F.size(r) == 0, 0.0).otherwise(hit / F.size("g"))
    precision = F.when(none, 1.0).when(F.size(r) == 0, 0.0).otherwise(hit / F.size(F.array_distinct(r)))
    if column_mode:
        recall = F.when(none, 1.0).otherwise(hit / F.size("g"))
    return met.select("q_id", recall.alias("recall"), precision.alias("precision"))


def f1(r, p):
    return F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0))


def f6(r, p):
    """Recall weighs six times as much as precision."""
    return F.coalesce(F.try_divide(37 * p * r, 36 * p + r), F.lit(0.0))
