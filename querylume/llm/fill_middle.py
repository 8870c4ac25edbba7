"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together again with marks between.

The kernel works on a whole Arrow batch of UTF-8 texts, not row by row. A table gives every byte its class; from the classes
of adjacent bytes comes a mask of the bytes at which a unit begins; its cumulative sums, counted from each document's
first byte, say which unit of its document a byte belongs to; and one search in them finds the bytes at which all rows
are cut. The pieces of all rows are then one Arrow array over the batch's own bytes, with the cuts as its offsets.

Where a row is cut, and its form, are a function of its id and the seed alone, so they are the same on every run and
machine. Scale: one map over the documents; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylume.llm.common import fresh, table, tidy

PLAIN, PSM, SPM = "plain", "psm", "spm"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are rearranged; of 100 of these so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1
#: A batch is cut in slices of so many bytes, or of one text where that is longer.
SLICE = 4 << 20
_INNER, _SPACE, _LINE, _OTHER = range(4)  # continuation bytes, white space, line feed, all else
CLASSES = np.full(256, _OTHER, np.uint8)
CLASSES[0x80:0xC0] = _INNER
CLASSES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
CLASSES[0x0A] = _LINE
UNITS = ("code_point", "word", "line")


def _begins(data: np.ndarray, firsts: np.ndarray, unit: str) -> np.ndarray:
    """The mask of bytes that begin a unit: a code point; a word with the white space behind it; a line with its end.
    ``firsts`` are the first bytes of documents that aren't empty, which always begin one."""
    kinds = CLASSES[data]
    if unit == "code_point":
        return kinds != _INNER
    mask = np.zeros(len(data), bool)
    if unit == "word":
        space = (kinds == _SPACE) | (kinds == _LINE)
        mask[1:] = space[:-1] & ~space[1:]
    else:
        mask[1:] = kinds[:-1] == _LINE
    mask[firsts] = True
    return mask


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the bytes, of an Arrow string array without nulls."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], data


def cut(texts: pa.Array, hashes: np.ndarray, plain: np.ndarray, unit: str = "code_point") -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Units of each text, units before its first and its second cut, and the pieces: three for each text, in order.
    Cuts are ``hashes`` (two a row) modulo one more than the units; a plain text is its own first piece."""
    offsets, data = _bytes_of(texts)
    first, end = offsets[:-1], offsets[1:]
    sums = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(_begins(data, first[first < end], unit), out=sums[1:])
    before = sums[first].astype(np.int64)  # units of the batch before the document, from which its own are counted
    n = sums[end].astype(np.int64) - before
    cuts = np.sort(hashes % (n + 1)[:, None], axis=1)
    cuts[plain] = n[plain, None]
    # unit k of a document begins at the first byte whose sum is before + k + 1; behind the last lies the next document
    at = np.searchsorted(sums[1:], (before[:, None] + cuts + 1).astype(sums.dtype))
    at = np.minimum(at, end[:, None])
    edges = np.column_stack([first, at]).ravel()
    edges = np.append(edges, offsets[-1])
    wide = edges.astype(np.int32) if edges[-1] < 1 << 31 else edges
    make = pa.StringArray if wide.dtype == np.int32 else pa.LargeStringArray
    return n, cuts[:, 0], cuts[:, 1], make.from_buffers(len(edges) - 1, pa.py_buffer(wide), pa.py_buffer(np.ascontiguousarray(data)))


def rearrange(texts: pa.Array, hashes: np.ndarray, unit: str = "code_point", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Units, form (0 plain, 1 prefix first, 2 suffix first), both cuts and the outputs of a batch; four hashes a row."""
    marked = np.zeros(len(texts), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    plain = marked | empty | (hashes[:, 2] % 100 >= rate)
    form = np.where(plain, 0, np.where(hashes[:, 3] % 100 < suffix_first, 2, 1))
    n, one, two, pieces = cut(texts, hashes[:, :2], plain, unit)
    row = 3 * np.arange(len(form))
    piece = lambda which: pieces.take(pa.array(row + np.array(which)[form]))
    mark = lambda marks: pa.array(marks, pieces.type).take(pa.array(form))
    order = [mark(["", PREFIX, SUFFIX]), piece([0, 0, 2]), mark(["", SUFFIX, PREFIX]), piece([1, 2, 0]), mark(["", MIDDLE, MIDDLE]), piece([2, 1, 1])]
    return n, form, one, two, pc.binary_join_element_wise(*order, pa.scalar("", pieces.type))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _kernel(unit: str, rate: int, suffix_first: int):
    names = pa.array([PLAIN, PSM, SPM])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                texts = pc.fill_null(part.column("text"), "")
                hashes = np.column_stack([part.column(f"h{i}").to_numpy() for i in range(1, 5)])
                n, form, one, two, out = rearrange(texts, hashes, unit, rate, suffix_first)
                plain = form == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n), names.take(pa.array(form)), pa.array(one, mask=plain), pa.array(two - one, mask=plain), out.cast(pa.string()) if len(out) and out.nbytes < 1 << 31 else out],
                    ["id", "n", "form", "prefix_n", "middle_n", "output"],
                )

    return run


def hashes(id_: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the hex SHA-256 of ``seed``:id, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, unit: str = "code_point", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of ``docs``: id_col, n (units), form, prefix_n, middle_n (units; null if plain), output.

    ``unit`` is one of UNITS. Null and empty texts, texts that hold a mark, and 100 - ``rate`` of 100 others stay plain. A
    null id hashes as an empty one. Rows that repeat, or share their id, are cut each, alike if their texts are alike.
    Other columns are ignored, whatever their names. An empty table gives an empty result. A text of any length is cut
    whole; a task holds SLICE bytes of texts or one text at a time, with four bytes a byte for the sums."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *hashes(F.col(id_col), seed))
    out = rows.mapInArrow(_kernel(unit, rate, suffix_first), f"id {kind}, n long, form string, prefix_n long, middle_n long, output string")
    name = id_col if id_col.lower() not in ("n", "form", "prefix_n", "middle_n", "output") else fresh(out, id_col)[0]
    return out.withColumnRenamed("id", name)


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    glue = lambda *at: F.concat(*[F.get(parts, i) for i in at])
    return F.when(form == PSM, glue(1, 3, 2)).when(form == SPM, glue(2, 3, 1)).otherwise(output)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, cut and put together: doc_id, n, form, prefix_chars, middle_chars, output_sha256 and, of the text
    that is rebuilt from output and form, restored_sha256."""
    made = fill_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_n").alias("prefix_chars"), F.col("middle_n").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
    FROM documents
), h AS (
    SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS b,
        CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
    FROM d
), f AS (
    SELECT *, least(a, b) AS p, greatest(a, b) AS q,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), c AS (
    SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(prefix || middle || suffix) AS restored_sha256
FROM c
"""
