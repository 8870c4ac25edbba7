"""Ranked lexical search: MaxScore in every shard of an inverted index.

The index has shards of bounded size. A shard holds the ids and lengths of its documents, in the order of their ids, and for
each term of theirs the documents, how often they hold it, the most that any holds it, and the least length of one that
holds it. The last two bound the term's score in the shard whatever is asked later. The index is written once.

A search joins the postings of asked terms with the items that ask for them, and works shard by shard. An item's terms are
sorted by their upper bounds. As long as the bounds of the terms that are left add up to the k-th best score so far, the
next one is essential: all its postings are scored, for any document may still come in by it. The rest is non-essential:
its postings are only probed, from the highest bound down, for documents whose score and remaining bounds still reach
the k-th best. That score grows as lists are scored, and is carried from shard to shard of a task.

Scale: documents are read once, for the index. Only postings of asked terms are shuffled, by shard; a shard's k best for
each item are cut again before they meet. Items come in blocks of ITEMS, each of which meets every shard on its own.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querylume.llm.common import freeze, fresh, numbered, table, tidy

K = 20
#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD = 16 << 20
#: Items that search a shard together.
ITEMS = 1024
#: Asked terms are sent to every task up to this number (a term takes some 100 bytes), else they are joined by a shuffle.
MAX_BROADCAST_TERMS = 100_000
_TERMS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i >= 128 else 32 for i in range(256))
_PATTERN = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_PIECE = 1 << 20  # longer texts are split into terms piece by piece
_ROWS = 1 << 16


def counted(data: bytes) -> Counter:
    """How often each term stands in a text's UTF-8 bytes. Bytes of 128 and more are parts of terms, so bytes do."""
    data = data.translate(_TERMS)
    if len(data) <= _PIECE:
        return Counter(data.split())
    found, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def asked_terms(text: Column) -> Column:
    """The terms of a text, repeats included, as an array."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(_PATTERN), F.lit(1))


def _shard(ids: pa.Array, texts: pa.Array, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A shard's rows: its documents, then its terms."""
    order = pc.sort_indices(ids, null_placement="at_start")
    ids, texts = ids.take(order), pc.fill_null(texts, "").cast(pa.large_binary()).take(order)
    vocabulary: defaultdict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    term, tf, each, n = array("i"), array("q"), array("i"), array("q")
    for text in texts:
        found = counted(text.as_py())
        term.extend(map(vocabulary.__getitem__, found))
        tf.extend(found.values())
        each.append(len(found))
        n.append(found.total())
    empty = lambda name, rows: pa.nulls(rows, schema.field(name).type)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)
    lengths = np.frombuffer(n, np.int64)
    head = {"shard": pa.array([number], pa.int64()), "ids": one(ids, schema.field("ids").type), "n": one(pa.array(lengths), schema.field("n").type)}
    yield pa.RecordBatch.from_arrays([head.get(f.name, empty(f.name, 1)) for f in schema], schema=schema)
    terms = np.frombuffer(term, np.int32)
    at, tfs = np.repeat(np.arange(len(each), dtype=np.int32), np.frombuffer(each, np.int32)), np.frombuffer(tf, np.int64)
    by = np.argsort(terms, kind="stable")  # within a term the documents stay in order
    at, tfs = at[by], tfs[by]
    edges = np.append(np.flatnonzero(np.diff(terms[by], prepend=-1)), len(by)).astype(np.int32)
    firsts = edges[:-1]
    most, least = (np.maximum.reduceat(tfs, firsts), np.minimum.reduceat(lengths[at], firsts)) if len(firsts) else (tfs, tfs)
    columns = {
        "shard": pa.array(np.full(len(firsts), number, np.int64)), "term": pa.array(list(vocabulary), pa.binary()).cast(pa.string()), "df": pa.array(np.diff(edges).astype(np.int64)),
        "most_tf": pa.array(most), "least_n": pa.array(least), "at": pa.ListArray.from_arrays(edges, at), "tf": pa.ListArray.from_arrays(edges, tfs),
    }
    rows = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else empty(f.name, len(firsts)) for f in schema], schema=schema)
    for i in range(0, rows.num_rows, _ROWS):
        yield rows.slice(i, _ROWS)


def _index(most_bytes: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, schema = [], 0, TaskContext.get().partitionId() << 33, None

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: pa.concat_arrays(whole.column(c).chunks)
            yield from _shard(one("id"), one("text"), number, schema)

        for batch in batches:
            if schema is None:
                id_ = batch.schema.field("id").type
                schema = pa.schema([("shard", pa.int64()), ("ids", pa.list_(id_)), ("n", pa.list_(pa.int64())), ("term", pa.string()), ("df", pa.int64()), ("most_tf", pa.int64()), ("least_n", pa.int64()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                end = int(np.searchsorted(sizes, before + most_bytes - size, side="right"))
                if end == at and held:  # full, or the next text is too long for what is left
                    yield from flush()
                    held, size, number = [], 0, number + 1
                    continue
                end = max(end, at + 1)
                held.append(batch.slice(at, end - at))
                size += int(sizes[end - 1]) - before
                at = end
        if held:
            yield from flush()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """The index of all rows, written to the shared folder. A row without a term is one of a shard's documents: ids and
    their lengths n, in the order of ids (null first); one with a term has df, most_tf, least_n, and the documents by their
    places (at) with their counts (tf).

    Null and empty texts have no terms. Every row is a document, whether rows or ids repeat or not. Other columns are
    ignored. An empty table gives an empty index."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"shard long, ids array<{kind}>, n array<long>, term string, df long, most_tf long, least_n long, at array<int>, tf array<int>"
    return freeze(rows.mapInArrow(_index(shard), schema), "search-index", "zstd")


def _lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """12 m of a document of n terms, m being 100 - 25 + (25 n N) div L."""
    if len(n) and 25 * int(n.max()) * docs >= 1 << 63:
        return np.array([12 * (75 + 25 * int(x) * docs // total) for x in n], np.int64)
    return 12 * (75 + 25 * n * docs // total)


def _impact(tf: np.ndarray, m12: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + m12)


class Shard:
    """A shard's postings of asked terms, and the search in them."""

    def __init__(self, n: np.ndarray, docs: int, total: int, w: np.ndarray, most_tf: np.ndarray, least_n: np.ndarray, edges: np.ndarray, at: np.ndarray, tf: np.ndarray):
        self.m12 = _lengths(n, docs, total)
        self.w, self.edges, self.at, self.tf = w, edges, at, tf
        self.bounds = w * _impact(most_tf, _lengths(least_n, docs, total))
        self.scored: dict[int, np.ndarray] = {}
        self.probed = self.read = 0

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.edges[term], self.edges[term + 1]
        return self.at[a:b], self.tf[a:b]

    def scores(self, term: int) -> np.ndarray:
        if term not in self.scored:
            at, tf = self.list_of(term)
            self.scored[term] = self.w[term] * _impact(tf.astype(np.int64), self.m12[at])
        return self.scored[term]

    def search(self, terms: np.ndarray, counts: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents, best first, equal ones by place; none with a score below ``floor``
        or 1. ``counts`` says how often the item has each term."""
        bounds = self.bounds[terms] * counts
        order = np.argsort(-bounds, kind="stable")
        terms, counts = terms[order], counts[order]
        left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # what the lists from here on add at most
        floor, total, seen, j = max(floor, 1), np.zeros(len(self.m12), np.int64), 0, 0
        while j < len(terms) and left[j] >= floor:  # essential
            at, _ = self.list_of(terms[j])
            total[at] += self.scores(terms[j]) * counts[j]
            self.read += len(at)
            seen += len(at)
            j += 1
            if seen >= k and left[j]:
                floor = max(floor, _kth(total[total > 0], k))
        found = np.flatnonzero(total > 0)
        found = found[total[found] + left[j] >= floor]
        while j < len(terms) and len(found):  # non-essential
            at, tf = self.list_of(terms[j])
            place = np.minimum(np.searchsorted(at, found), len(at) - 1)
            hit = at[place] == found
            docs = found[hit]
            total[docs] += self.w[terms[j]] * _impact(tf[place[hit]].astype(np.int64), self.m12[docs]) * counts[j]
            self.probed += len(found)
            j += 1
            floor = max(floor, _kth(total[found], k))
            found = found[total[found] + left[j] >= floor]
        found = found[total[found] >= floor]
        best = found[np.argsort(-total[found], kind="stable")[:k]]
        return best, total[best]


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest, or 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _search(k: int, docs: int, total: int):
    floors: dict[int, np.ndarray] = {}  # of each item its k best scores in this task's shards so far

    def run(key: tuple, heads: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("item", pa.int64()), ("id", heads.schema.field("ids").type.value_type), ("score", pa.int64())])
        if not rows.num_rows:
            return schema.empty_table()
        one = lambda t, c: pa.concat_arrays(t.column(c).chunks)
        number = lambda c: one(rows, c).to_numpy(zero_copy_only=False)
        at, tf, uses = one(rows, "at"), one(rows, "tf"), one(rows, "uses")
        flat = uses.flatten()
        edges = at.offsets.to_numpy() - at.offsets[0].as_py()
        ids = one(heads, "ids").flatten()
        shard = Shard(one(heads, "n").flatten().to_numpy().astype(np.int64), docs, total, number("w"), number("most_tf"), number("least_n"), edges, at.flatten().to_numpy(), tf.flatten().to_numpy())
        item, count = (flat.field(c).to_numpy().astype(np.int64) for c in ("item", "count"))
        term = np.repeat(np.arange(rows.num_rows), np.diff(uses.offsets.to_numpy()))
        order = np.argsort(item, kind="stable")
        item, count, term = item[order], count[order], term[order]
        firsts = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
        items, places, scores = [], [], []
        for a, b in zip(firsts[:-1], firsts[1:]):
            which, best = int(item[a]), floors.get(int(item[a]), np.zeros(0, np.int64))
            found, score = shard.search(term[a:b], count[a:b], k, int(best[-1]) if len(best) == k else 0)
            if len(found):
                floors[which] = np.sort(np.concatenate([best, score]))[::-1][:k]
                items.append(np.full(len(found), which))
                places.append(found)
                scores.append(score)
        if not items:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(items)), ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], schema=schema)

    return run


def search(index: DataFrame, items: DataFrame, k: int = K, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each item's k best documents with a score above 0: item_col, rank (from 1), id_col, score. Equal scores go by
    ascending id (null first).

    Rows of one item (null is an item too) that differ in their text are one item with all their terms; rows that repeat
    count once. An item without terms, or whose terms no document holds, has no rows. Other columns are ignored."""
    names = [item_col, "rank", id_col, "score"]
    if len({n.lower() for n in names}) < 4:
        raise ValueError("item_col and id_col must differ, also from rank and score")
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    heads, postings = index.where("term is null").select("shard", "ids", "n"), index.where("term is not null")
    stats = heads.select(F.size(F.filter("n", lambda x: x > 0)).alias("d"), F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("l")).agg(F.sum("d"), F.sum("l")).first()
    docs, total = stats[0] or 0, stats[1] or 0
    words = items.select(F.col(item_col).alias("_item"), F.col(text_col).cast("string").alias("_text")).distinct().select("_item", F.explode(asked_terms(F.col("_text"))).alias("term"))
    each = words.groupBy("_item", "term").agg(F.count("*").alias("count"))
    known = numbered(each.select("_item").distinct(), "item", F.col("_item"), what="search-items")
    asked = freeze(each.join(known, each["_item"].eqNullSafe(known["_item"])).select("item", "term", "count"), "search-terms")
    few = asked.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df  # counted just now
    held = postings.select("term", "df").join(small(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weights = held.select("term", w.alias("w")).where("w > 0")
    block = F.floor(F.col("item") / ITEMS)
    uses = asked.join(weights, "term").groupBy(block.alias("block"), "term", "w").agg(F.collect_list(F.struct("item", "count")).alias("uses"))  # at most ITEMS
    blocks = (known.agg(F.max("item")).first()[0] or 0) // ITEMS + 1
    rows = postings.select("shard", "term", "most_tf", "least_n", "at", "tf").join(small(uses), "term").drop("term")
    there = heads.select(F.col("shard").alias("of"), "ids", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("to"))
    met = there.groupBy("of", "to").cogroup(rows.groupBy("shard", "block")).applyInArrow(_search(k, docs, total), f"item long, id {id_kind}, score long")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc("id")))
    best = met.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(known, "item").select(F.col("_item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Each ``benchmark`` item's 20 best of all ``documents``: item_id, rank, doc_id, score."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
    SELECT rowid_, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
), postings AS (
    SELECT rowid_, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY rowid_, term
), lengths AS (
    SELECT rowid_, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY rowid_
), totals AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs
), asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark))
    GROUP BY item_id, term
), scored AS (
    SELECT item_id, p.rowid_, any_value(p.doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN postings p USING (term) JOIN weights USING (term) JOIN lengths USING (rowid_), totals
    GROUP BY item_id, p.rowid_
), placed AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
