"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

Words are the lower-cased maximal runs of word characters; an n-gram is NGRAM successive words (a shorter text is one
n-gram of all its words). Texts with one set of n-grams form a class. Classes share a bucket where all hashes of a band
agree; the band and row counts are the longest bands that reach RECALL at the threshold within MAX_HASHES hashes.

Pairs are never listed. Buckets give star edges, their components are the groups to verify. A group is packed with
others, or, beyond PACK_GRAMS n-grams, split into chunks, of which those pairs are compared that share a bucket. A
comparison task holds two chunks at most, counts intersections with an inverted index, and returns for each class its
count of links and one edge of a spanning forest: as many rows as classes, however dense the group.
Chunks grow with their group, up to MAX_CHUNK_GRAMS n-grams, so that a group has CHUNKS of them and its texts are sent
that often at most, unless it is larger than CHUNKS of the largest chunks.

Scale: the corpus is shuffled once, as text, to bring candidates to their group; band hashes are shuffled twice.
Copies are pre-aggregated into their class first. A set, a bucket, a node or a group that very many rows share is joined
by join_hot.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querylume.llm.common import components, drop_frozen, freeze, fresh, join_hot, numbered, table, tidy

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 150
PACK_GRAMS = 100_000
MAX_CHUNK_GRAMS = 4_000_000
CHUNKS = 64
_SEED = 11
_WORD = re.compile(r"\w+")
_CACHE_WORDS = 200_000
_EPS = 1e-9


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which a pair at the threshold meets in some band with probability
    ``recall``, in at most ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        meets = threshold**rows
        bands = 1 if meets >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-meets)) if meets > 1e-12 else max_hashes + 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Text to the sorted array of its distinct n-grams, as 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.words = n, _WordHash()
        self.factors = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        x = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(x))
        total = x[: len(x) - n + 1] * self.factors[0]
        for k in range(1, n):
            total = total + x[k : len(x) - n + 1 + k] * self.factors[k]
        return np.unique(_mix(total))


class Banding:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(_SEED)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.xor = rng.integers(0, 2**64, k, dtype=np.uint64)[:, None]
        self.times = (rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1))[:, None]
        self.factors = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.xor), np.uint64(2**64 - 1))
        for at in range(0, len(grams), 4096):
            part = grams[None, at : at + 4096]
            for k in range(0, len(low), 16):
                low[k : k + 16] = np.minimum(low[k : k + 16], ((part ^ self.xor[k : k + 16]) * self.times[k : k + 16]).min(axis=1))
        per_band = (_mix(low).reshape(self.bands, self.rows) * self.factors).sum(axis=1, dtype=np.uint64)
        return _mix(per_band + self.salt).view(np.int64)


def _signatures(n: int, bands: int, rows: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, band = Shingler(n), Banding(bands, rows)
        for batch in batches:
            grams, digests, hashes = [], [], []
            for text in batch.column("text"):
                found = shingle(text.as_py())
                grams.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                hashes.append(band(found) if len(found) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "_at": batch.column("_at"), "_grams": pa.array(grams, pa.int64()),
                "_set": pa.array(digests, pa.binary()), "_bands": pa.array(hashes, pa.list_(pa.int64())),
            })

    return run


def _links(n: int, threshold: float):
    """For the texts of a pack or of two chunks: per class the weight of its links, and edges of a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("_class").reset_index(drop=True)
        shingle = Shingler(n)
        sets = [shingle(t) for t in pdf["text"]]
        lens = np.array([len(s) for s in sets], np.int64)
        groups = _mix(pdf["_root"].to_numpy(np.int64).view(np.uint64) + np.uint64(1))
        keys, inv = np.unique(np.concatenate([s ^ g for s, g in zip(sets, groups)]), return_inverse=True)
        of = np.repeat(np.arange(len(sets)), lens)
        order = np.argsort(inv, kind="stable")
        holders, starts = of[order], np.searchsorted(inv[order], np.arange(len(keys) + 1))
        spread = np.diff(starts)
        ends = np.cumsum(lens)
        side, weight = pdf["_chunk"].to_numpy(), pdf["_n"].to_numpy(np.int64)
        two = len(set(side)) > 1 and bool(pdf["_cross"].iloc[0])
        linked, parent = np.zeros(len(sets), np.int64), list(range(len(sets)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in range(len(sets)):
            mine = inv[ends[i] - lens[i] : ends[i]]
            mine = mine[spread[mine] > 1]
            if not len(mine):
                continue
            m = spread[mine]
            flat = np.arange(m.sum()) + np.repeat(starts[mine] - np.cumsum(m) + m, m)
            both = np.bincount(holders[flat], minlength=len(sets))
            good = both >= threshold * (lens + lens[i] - both) - _EPS
            good[i] = False
            if two:
                good &= side != side[i]
            other = np.flatnonzero(good)
            linked[i] = weight[other].sum()
            for j in other[other > i]:
                a, b = top(i), top(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        tops, classes = np.array([top(i) for i in range(len(sets))]), pdf["_class"].to_numpy()
        out = pd.DataFrame({"_class": classes, "_to": classes[tops], "_links": linked})
        return out[out["_links"] > 0]

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> DataFrame:
    """One row per row of ``docs``: id_col, class_id (smallest id that the links connect it with, itself included),
    n_links (other documents whose n-gram sets have a Jaccard index of ``threshold`` or more with its own, copies
    included), rep_id (smallest id with the very same set), n_copies (documents with that set), n_grams.

    A null text, or one without words, has no links and is its own class. Rows that repeat are documents of their own.
    A null id comes first where the smallest is sought. Other columns are ignored. An empty table gives an empty
    result."""
    out = _joined(docs, id_col, text_col, n, threshold, recall, max_hashes)
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", "rep_id", "n_copies", "n_grams")


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> DataFrame:
    """What jaccard_join returns, the id as ``id``, with the hash of the text (_at) and that of the class_id's (_class_at)."""
    bands, rows = choose_bands(threshold, recall, max_hashes)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("_at"))
    kind = base.schema["id"].dataType.simpleString()
    sig = freeze(base.mapInArrow(_signatures(n, bands, rows), f"id {kind}, _at long, _grams long, _set binary, _bands array<long>"), "join-signatures")
    full = sig.where("_grams > 0")
    per = full.groupBy("_set").agg(F.min(F.struct("id", "_at")).alias("_rep"), F.count("*").alias("_n"), F.first("_bands").alias("_bands"), F.first("_grams").alias("_grams"))
    classes = numbered(per, "_class", F.col("_set"), what="join-classes")

    meets = classes.select("_class", F.explode("_bands").alias("_h"))
    buckets = freeze(meets.groupBy("_h").agg(F.min("_class").alias("_low"), F.count("*").alias("_m")).where("_m > 1"), "join-heads")
    met = freeze(join_hot(meets, buckets, ["_h"], "_m", bands * classes.count()).drop("_m"), "join-buckets")
    groups = components(met.select(F.col("_class").alias("a"), F.col("_low").alias("b")), "join-candidates")
    cand = groups.select(F.col("node").alias("_class"), F.col("root").alias("_root")).join(classes.select("_class", "_rep", "_n", "_grams", F.col("_bands")[0].alias("_first")), "_class")
    cand = freeze(cand, "join-grouped")
    total = cand.count()

    # chunks of large groups: by the first band's hash, which similar texts tend to share, and where one hash has too
    # much, by a hash of the class
    weight = cand.groupBy("_root").agg(F.sum("_grams").alias("_w"), F.count("*").alias("_m"))
    target = F.least(F.greatest(F.col("_w") / CHUNKS, F.lit(PACK_GRAMS)), F.lit(max(PACK_GRAMS, MAX_CHUNK_GRAMS)))
    parts = freeze(weight.select("_root", "_w", "_m", target.alias("_target"), F.ceil(F.col("_w") / target).alias("_parts")), "join-weights")
    packs = max(1, math.ceil((parts.where("_parts = 1").agg(F.sum("_w")).first()[0] or 0) / PACK_GRAMS))
    placed = join_hot(cand, parts, ["_root"], "_m", total).drop("_m", "_w")
    heavy = placed.where("_parts > 1").groupBy("_root", "_first").agg(F.ceil(F.sum("_grams") / F.first("_target")).alias("_sub"), F.count("*").alias("_m"))
    large = join_hot(placed.where("_parts > 1"), freeze(heavy, "join-heavy"), ["_root", "_first"], "_m", total).drop("_m")
    chunk = F.pmod(F.xxhash64("_first"), F.col("_parts")) * F.lit(1 << 20) + F.pmod(F.xxhash64("_class"), F.col("_sub"))
    names = ["_class", "_root", "_n", "_rep", "_chunk"]
    big = freeze(large.withColumn("_chunk", chunk).select(names), "join-chunks")
    seen = met.select("_h", "_class").join(big.select("_class", "_root", "_chunk"), "_class").select("_h", "_root", "_chunk").distinct()
    listed = seen.groupBy("_h", "_root").agg(F.array_sort(F.collect_list("_chunk")).alias("_c"))  # at most a group's chunks
    first = listed.select("_root", "_c", F.explode("_c").alias("_i"))
    tiles = first.select("_root", "_i", F.explode(F.filter("_c", lambda c: c >= F.col("_i"))).alias("_j")).distinct()
    ends = tiles.select("_root", F.array_distinct(F.array("_i", "_j")).alias("_e"), "_i", "_j")
    ends = ends.select("_root", F.explode("_e").alias("_chunk"), F.concat_ws("-", F.lit("t"), "_root", "_i", "_j").alias("_tile"), (F.col("_i") != F.col("_j")).alias("_cross"))
    ends = ends.groupBy("_root", "_chunk").agg(F.collect_list(F.struct("_tile", "_cross")).alias("_to"))  # as many as the group has chunks
    sizes = big.groupBy("_root", "_chunk").agg(F.count("*").alias("_m"))
    tiled = join_hot(big, freeze(ends.join(sizes, ["_root", "_chunk"]), "join-tiles"), ["_root", "_chunk"], "_m", total).select(*names, F.inline("_to"))
    one = placed.where("_parts = 1").select(*names[:-1], F.lit(0).cast("long").alias("_chunk"), F.concat_ws("-", F.lit("p"), F.pmod(F.xxhash64("_root"), F.lit(packs))).alias("_tile"), F.lit(False).alias("_cross"))
    dealt = tiled.union(one).select("_class", "_root", "_chunk", "_n", "_tile", "_cross", F.col("_rep.id").alias("_id"), F.col("_rep._at").alias("_x"))
    texts = base.join(dealt, base["id"].eqNullSafe(dealt["_id"]) & base["_at"].eqNullSafe(dealt["_x"]))
    texts = texts.select("_tile", "_class", "_root", "_chunk", "_cross", "_n", "text")
    links = freeze(texts.groupBy("_tile").applyInPandas(_links(n, threshold), "_class long, _to long, _links long"), "join-links")

    joined = components(links.select(F.col("_class").alias("a"), F.col("_to").alias("b")), "join-classes-linked")
    facts = classes.select("_set", "_class", "_rep", "_n")
    facts = facts.join(joined.select(F.col("node").alias("_class"), "root"), "_class", "left").join(links.groupBy("_class").agg(F.sum("_links").alias("_links")), "_class", "left")
    facts = freeze(facts.withColumn("root", F.coalesce("root", "_class")), "join-facts")
    lows = freeze(facts.groupBy("root").agg(F.min("_rep").alias("_low"), F.count("*").alias("_m")), "join-lows")
    facts = join_hot(facts, lows, ["root"], "_m", classes.count())
    facts = freeze(facts.select("_set", "_low", "_rep", "_n", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("n_links")), "join-facts")
    drop_frozen(classes, buckets, met, groups, cand, parts, big, links, joined, lows)
    out = join_hot(full.select("id", "_at", "_set", "_grams"), facts, ["_set"], "_n", sig.count())
    out = out.select("id", F.col("_low.id").alias("class_id"), "n_links", F.col("_rep.id").alias("rep_id"), F.col("_n").alias("n_copies"), F.col("_grams").alias("n_grams"), "_at", F.col("_low._at").alias("_class_at"))
    own = F.col("id")
    bare = sig.where("_grams = 0").select("id", own.alias("class_id"), F.lit(0).cast("long").alias("n_links"), own.alias("rep_id"), F.lit(1).cast("long").alias("n_copies"), F.col("_grams").alias("n_grams"), "_at", F.col("_at").alias("_class_at"))
    return out.unionByName(bare)


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group that links connect, with all columns: that with the group's class_id, and where different
    texts of the group have that id, the one whose text has the smallest hash. Of rows that repeat one stays, any.

    Null texts and texts without words have no links: all such rows stay. A null id comes first where the smallest is
    sought. Columns may have any names. An empty table gives an empty result."""
    id_, at, row = fresh(docs, "_q_id", "_q_at", "_q_row")
    found = _joined(docs.select(id_col, text_col), id_col, text_col, **options)
    stays = found.where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("_at") == F.col("_class_at")))
    stays = freeze(stays.groupBy(F.col("id").alias(id_), F.col("_at").alias(at)).agg(F.count("*").alias("_rows"), F.max(F.col("n_grams") == 0).alias("_bare")), "join-stays")
    one, many = stays.where("_bare or _rows = 1").select(id_, at), stays.where("not _bare and _rows > 1").select(id_, at)
    same = lambda s: docs[id_col].eqNullSafe(s[id_]) & (F.xxhash64(docs[text_col]) == s[at])
    repeated = docs.join(many, same(many)).withColumn(row, F.row_number().over(W.partitionBy(id_, at).orderBy(F.lit(0))))
    return docs.join(one, same(one), "left_semi").unionByName(repeated.where(F.col(row) == 1).select(docs.columns))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all ``documents``: doc_id, class_id, n_links, rep_id, n_copies, n_grams."""
    return jaccard_join(table(spark, sf_dir, "documents"))
