"""Exact dedup by deterministic block naming; DataFrame functions only.

A normalised text is cut into blocks of BLOCK_CHARS characters. The distinct blocks are put in order and numbered;
a text becomes a sequence of integers. Then adjacent pairs of names are numbered in their order, again and again,
until each text has a single name. Two texts have one name if and only if they have equal blocks all along, and only
names say which documents are equal.

The SHA-256 of a block serves as the key by which its text is shuffled, never as proof of equality: every key's set of
distinct contents is gathered and must have one member, else the query stops with an error. So no collision can pass.

Scale: block contents are shuffled once, behind a map-side union of equal ones; everything later moves keys or integers,
one for each BLOCK_CHARS characters of text, and half as many from level to level. A block, a pair or a group that very
many documents share is joined by join_hot: the few hot ones are broadcast, and their documents stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querylume.llm.common import drop_frozen, freeze, fresh, join_hot, numbered, table

BLOCK_CHARS = 4096
WHITE_SPACE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without its ASCII white space; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK_CHARS), F.lit(0))


def _key(block: Column) -> Column:
    return F.unhex(F.sha2(block, 256))


def _named(rows: DataFrame, names: DataFrame, on: list[str], total: int) -> DataFrame:
    """(_sid, _pos, *on) to (_sid, _names): the names in the order of positions."""
    met = join_hot(rows, names.select(*on, "_name", "_n"), on, "_n", total)
    listed = met.groupBy("_sid").agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_l"))
    return listed.select("_sid", F.transform("_l", lambda x: x["_name"]).alias("_names"))


def name_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_chars, text_sha256, level and name (equal for equal normalised texts,
    different for others), keep_id, group_size, kept.

    Null text counts as empty; all empty texts are equal. Of a group the row with the most code points in the original
    text stays, then the smallest id (a null id comes first). Where that id stands on several rows with equal texts and
    lengths, all of them are marked kept. Other columns are ignored. An empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n_chars"), normalised(F.col(text_col)).alias("_t"))
    keys = F.when(F.col("_t") == "", F.array().cast("array<binary>")).otherwise(F.transform(_blocks(F.col("_t")), _key))
    members = base.select("id", "n_chars", F.sha2("_t", 256).alias("text_sha256"), keys.alias("_seq"))
    members = freeze(members.withColumn("_sid", F.monotonically_increasing_id()), "naming-members")
    total, n_blocks, longest = members.agg(F.count("*"), F.coalesce(F.sum(F.size("_seq")), F.lit(0)), F.coalesce(F.max(F.size("_seq")), F.lit(0))).first()

    blocks = base.where("_t <> ''").select(F.explode(_blocks(F.col("_t"))).alias("_b")).select(_key(F.col("_b")).alias("_key"), "_b")
    held = blocks.groupBy("_key").agg(F.collect_set("_b").alias("_c"), F.count("*").alias("_n"))
    sure = F.when(F.size("_c") == 1, F.col("_key")).otherwise(F.raise_error(F.lit("two different blocks share a SHA-256 key")).cast("binary"))
    names = numbered(held.select(sure.alias("_key"), "_n"), "_name", F.col("_key"), what="naming-blocks")
    at0 = members.select("_sid", F.posexplode("_seq").alias("_pos", "_key"))
    cur = freeze(_named(at0, names, ["_key"], n_blocks), "naming-0")
    drop_frozen(names)
    empty = members.where(F.size("_seq") == 0).select("_sid", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))
    done = empty.union(cur.where(F.size("_names") == 1).select("_sid", F.lit(0), F.col("_names")[0]))
    used, level = [cur], 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        many = cur.where(F.size("_names") > 1)
        at = F.sequence(F.lit(0), F.floor((F.size("_names") - 1) / 2).cast("int"))
        pair = lambda i: F.struct(F.get("_names", i * 2).alias("a"), F.coalesce(F.get("_names", i * 2 + 1), F.lit(-1).cast("long")).alias("b"))  # noqa: E731, B023
        pairs = many.select("_sid", F.posexplode(F.transform(at, pair)).alias("_pos", "_p")).select("_sid", "_pos", "_p.a", "_p.b")
        names = numbered(pairs.groupBy("a", "b").agg(F.count("*").alias("_n")), "_name", F.col("a"), F.col("b"), what=f"naming-pairs-{level}")
        cur = freeze(_named(pairs, names, ["a", "b"], n_blocks), f"naming-{level}")
        drop_frozen(names)
        used.append(cur)
        done = done.union(cur.where(F.size("_names") == 1).select("_sid", F.lit(level), F.col("_names")[0]))
    named = freeze(members.drop("_seq").join(done, "_sid").drop("_sid"), "naming-named")
    drop_frozen(members, *used)
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("id"))).alias("_best")
    groups = named.groupBy("level", "name").agg(best, F.count("*").alias("group_size"))
    out = join_hot(named, freeze(groups, "naming-groups"), ["level", "name"], "group_size", total)
    kept = F.col("id").eqNullSafe(F.col("_best.id")) & (F.col("n_chars") == -F.col("_best.c"))
    return out.select(F.col("id").alias(id_col), F.col("_best.id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "n_chars", "level", "name")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each normalised text, with all their columns."""
    id_, sha, n, row = fresh(docs, "_q_id", "_q_sha", "_q_n", "_q_row")
    named = name_blocks(docs.select(id_col, text_col), id_col, text_col).where("kept")
    named = named.groupBy(F.col(id_col).alias(id_), F.col("text_sha256").alias(sha), F.col("n_chars").alias(n)).agg(F.count("*").alias("_rows"))
    named = freeze(named, "naming-kept")
    one, many = named.where("_rows = 1").drop("_rows"), named.where("_rows > 1").drop("_rows")
    text = F.coalesce(docs[text_col], F.lit(""))
    same = lambda k: docs[id_col].eqNullSafe(k[id_]) & (F.sha2(normalised(text), 256) == k[sha]) & (F.char_length(text) == k[n])
    first = F.row_number().over(W.partitionBy(id_, sha, n).orderBy(F.lit(0)))
    repeated = docs.join(many, same(many)).withColumn(row, first).where(F.col(row) == 1).select(docs.columns)
    return docs.join(one, same(one), "left_semi").unionByName(repeated)


def op3_block_naming(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates among all ``documents``: doc_id, keep_id, group_size, kept, text_sha256."""
    return name_blocks(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents),
g AS (SELECT t, arg_min(doc_id, (-n_chars, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
