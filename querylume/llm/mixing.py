"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a budget in words. Whole passes over the source come first; the rest of the budget is filled from the
source's histogram of exact document lengths: a proportional share of every length, a seeded greedy fill, and for what
then remains a bounded-knapsack dynamic programme over lengths and their counts, run on a bitset of reachable sums.
How many documents of each length are taken is thus fixed; which ones, a seeded hash of the document id says.

Scale: documents are read once; only (id, source, length) is shuffled, keyed by (source, length, hash bucket), so that
a source or a length with a third of all rows falls into HASH_BUCKETS groups. The dynamic programme of a source sees
one row for each distinct length, however many documents there are.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querylume.llm.common import drop_frozen, freeze, fresh, numbered, table

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 17
HASH_BUCKETS = 256
#: The words that are left to the dynamic programme, unless the budget is smaller.
DP_WORDS = 1 << 15
WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than the six of ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_lengths(lengths: list[int], counts: list[int], budget: int, seed: int, dp_words: int = DP_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be found, and
    at most ``counts`` of each. Exact whenever the last ``dp_words`` words can be composed of the lengths left over."""
    total = sum(n * c for n, c in zip(lengths, counts))
    take = [0] * len(lengths)
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return list(counts)
    greedy = max(0, budget - dp_words)
    left = greedy
    for i, (n, c) in enumerate(zip(lengths, counts)):
        take[i] = min(c, c * greedy // total)
        left -= take[i] * n
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    for i in order:
        if 0 < lengths[i] <= left:
            more = min(counts[i] - take[i], left // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    budget -= sum(t * n for t, n in zip(take, lengths))
    # Bounded knapsack: items of a length are grouped by powers of two; bit s of `sums` says that s words can be had.
    # Sums may pass the budget, by less than the budget itself, by which the empty sum falls short.
    mask = (1 << (2 * budget + 1)) - 1
    sums, stages = 1, []
    for i in order:
        spare, step = counts[i] - take[i], 1
        while spare > 0 and 0 < lengths[i] * step <= 2 * budget:
            step = min(step, spare)
            stages.append((i, step, sums))
            sums = (sums | (sums << (lengths[i] * step))) & mask
            spare -= step
            step *= 2
        if sums >> budget & 1:
            break
    under = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
    over = sums >> (budget + 1)
    at = under
    if over and (gap := (over & -over).bit_length()) < budget - under:
        at = budget + gap
    for i, step, before in reversed(stages):
        if not before >> at & 1:
            take[i] += step
            at -= lengths[i] * step
    return take


def _fit_source(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_size", kind="stable")
        lengths, counts = [int(x) for x in pdf["_size"]], [int(x) for x in pdf["_n"]]
        pdf["_want"] = fit_lengths(lengths, counts, int(pdf["_rest"].iloc[0]), seed)
        return pdf[["_src", "_size", "_want"]]

    return run


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Adds ``_target`` to (_src, source, _total): shares of all words by weight, in code point order of the source
    with null last; a target stops at ``cap`` times the source's words and the excess goes to the others by weight,
    until none is above. Each round is one aggregate over the sources, whose two sums come to the driver."""
    ordered = numbered(sources, "_rank", F.col("source").asc_nulls_last(), what="mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    placed = ordered.withColumn("_weight", weight).withColumn("_cap", F.col("_total") * F.lit(float(cap)))
    all_words = placed.agg(F.sum("_total")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # ends: the number of full sources only rises
        is_full = F.col("_weight") * F.lit(level) >= F.col("_cap")
        held, open_, n = placed.agg(F.sum(F.when(is_full, F.col("_cap"))), F.sum(F.when(~is_full, F.col("_weight"))), F.count_if(is_full)).first()
        if n == full or not open_:
            break
        full, level = n, (all_words - (held or 0.0)) / open_
    out = placed.withColumn("_target", F.least("_cap", F.col("_weight") * F.lit(level))).drop("_rank", "_weight", "_cap")
    out._frozen_at = ordered._frozen_at
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id_col, source_col, size, source_size, target, repeats, taken (= repeats * size).

    Null text has size 0; a document of size 0 is never taken (repeats 0). A null source is a source of its own, the
    last. Rows that repeat are documents of their own. Ties between documents of one source and length are broken by
    the seeded hash of the id; rows with one id are interchangeable. Columns beside the three are ignored. An empty
    table gives an empty result."""
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("_size"))
    mixed = F.xxhash64(F.lit(seed), F.col("id"))
    base = base.select("id", "source", src.alias("_src"), "_size", mixed.alias("_hash"))
    base = freeze(base.withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(HASH_BUCKETS)).cast("int")), "mix-sizes")
    cells = freeze(base.groupBy("_src", "_size", "_bucket").agg(F.count("*").alias("_n")), "mix-cells")
    sources = base.groupBy("_src").agg(F.first("source").alias("source"), F.sum("_size").alias("_total"))
    goals = targets(sources, weights, cap)
    passes = F.when(F.col("_total") > 0, F.least(F.floor(F.col("_target") / F.col("_total")), F.lit(cap))).otherwise(0)
    plan = goals.withColumn("_passes", passes.cast("long"))
    rest = F.when(F.col("_passes") < cap, F.round(F.col("_target") - F.col("_passes") * F.col("_total")).cast("long")).otherwise(0)
    plan = freeze(plan.withColumn("_rest", rest), "mix-plan")
    drop_frozen(goals)
    lengths = cells.where("_size > 0").groupBy("_src", "_size").agg(F.sum("_n").alias("_n"))
    lengths = lengths.join(plan.select("_src", "_rest"), "_src").where("_rest > 0")
    wanted = lengths.groupBy("_src").applyInPandas(_fit_source(seed), "_src string, _size long, _want long").where("_want > 0")
    # the first buckets are taken whole; in the bucket where the count is reached, the first by hash
    upto = W.partitionBy("_src", "_size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    quota = cells.join(wanted, ["_src", "_size"]).withColumn("_left", F.col("_want") - F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    quota = quota.where("_left > 0").select("_src", "_size", "_bucket", "_left")
    order = W.partitionBy("_src", "_size", "_bucket").orderBy("_hash", "id")
    chosen = base.join(quota, ["_src", "_size", "_bucket"], "left").withColumn("_row", F.row_number().over(order))
    chosen = chosen.join(plan.select("_src", "_total", "_target", "_passes"), "_src")
    repeats = F.when(F.col("_size") > 0, F.col("_passes") + F.when(F.col("_row") <= F.col("_left"), 1).otherwise(0)).otherwise(0).cast("long")
    return chosen.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), repeats.alias("repeats"), (repeats * F.col("_size")).alias("taken"))


def take_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with all their columns. Rows with one id, source and
    text length are interchangeable; should the mix take them unequally, their repeats are evened out."""
    id_, source, size, total, rows, row, times, time = fresh(docs, "_q_id", "_q_source", "_q_size", "_q_all", "_q_rows", "_q_row", "_q_times", "_q_time")
    mixed = mix_sources(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, **options)
    mixed = mixed.select(F.col(id_col).alias(id_), F.col(source_col).alias(source), F.col("size").alias(size), "repeats")
    mixed = mixed.groupBy(id_, source, size).agg(F.sum("repeats").alias(total), F.count("*").alias(rows)).where(F.col(total) > 0)
    same = docs[id_col].eqNullSafe(mixed[id_]) & docs[source_col].eqNullSafe(mixed[source]) & (word_count(docs[text_col]) == mixed[size])
    met = docs.join(mixed, same).withColumn(row, F.row_number().over(W.partitionBy(id_, source, size).orderBy(F.lit(0))) - 1)
    each = F.floor(F.col(total) / F.col(rows)) + F.when(F.col(row) < F.col(total) % F.col(rows), 1).otherwise(0)
    met = met.withColumn(times, each.cast("int")).where(F.col(times) > 0)
    return met.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Mixes all ``documents``: doc_id, size, source_size, target, taken, then source and repeats."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")
