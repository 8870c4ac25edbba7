"""License scan: ordered signature rules over the words of a text.

A text is lower-cased (A to Z only) and everything but words becomes blanks, byte for byte, so that places in it stay
places in the text. Hundreds of hand-written rules (``license_rules``) are tried in order, each only on texts that hold all
of its keywords. What they find is resolved: of detections that lie within each other the one with the higher priority
stays, then the longer one, the earlier one, the earlier rule. Detections that only overlap stay both.

Detections that stay never lie within each other, so sorted by their starts they are sorted by their ends too, and one
binary search tells whether a new one lies within, or around, one of them; time grows with n log n, however often a text
repeats a license. Beside the rules, three fixed phrases are counted at all of their places, whatever the rules say.

Scale: one map over the documents; nothing is shuffled. A task holds one text, one byte a byte for its words, and eight
bytes for each word of a text with a detection.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylume.llm.common import fresh, table, tidy
from querylume.llm.license_rules import BASE, KINDS, RULES

#: Words keep their bytes, A to Z become lower case, everything else a blank.
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i >= 128 else 32 for i in range(256))
_BLANK = 32
_MACROS = {"LIC": "licen[cs]e", "VER": "(?:version |v ?)?"}


def _compiled(pattern: str) -> re.Pattern:
    """Blanks stand for any number of blanks, an optional blank for none too. A match begins behind a blank and ends
    before one."""
    for name, meaning in _MACROS.items():
        pattern = pattern.replace(name, meaning)
    pattern = pattern.replace(" ?", "\0").replace(" ", " +").replace("\0", " *")
    return re.compile(f" (?:{pattern})(?= )".encode() if "|" in pattern.split("(")[0] else f" {pattern}(?= )".encode(), re.S)


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    kind: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]


def rules_of(text: str = RULES) -> list[Rule]:
    out = []
    for line in text.strip().splitlines():
        label, kind, keywords, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append(Rule(len(out), label, kind, tuple(f" {k}".encode() for k in keywords.split(",")), _compiled(pattern)))
    return out


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of detections (first word, word behind the last, priority, rule) those that stay, by their places."""
    starts: list[int] = []
    kept: list[tuple[int, int, int, int]] = []
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        at = bisect_right(starts, d[0])
        if at and kept[at - 1][1] >= d[1]:
            continue  # within the last that begins no later, which of those ends last
        at = bisect_left(starts, d[0])
        if at < len(kept) and kept[at][1] <= d[1]:
            continue  # around the first that begins no earlier, which of those ends first
        starts.insert(at, d[0])
        kept.insert(at, d)
    return kept


class Scanner:
    def __init__(self, rules: list[Rule] | None = None, base: tuple[tuple[str, str], ...] = BASE):
        self.rules = rules_of() if rules is None else rules
        self.base = [(label, tuple(f" {w}".encode() for w in phrase.split()), _compiled(phrase)) for phrase, label in base]
        keywords = {k for r in self.rules for k in r.keywords} | {k for _, ks, _ in self.base for k in ks}
        # a keyword that begins with another is only looked for where the shorter one is there
        shorter = {k: next((s for s in sorted(keywords, key=len) if s != k and k.startswith(s)), None) for k in keywords}
        self.keywords = sorted(((k, shorter[k]) for k in keywords), key=lambda x: len(x[0]))

    def __call__(self, words: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Of a masked text: the places of the base phrases with their labels, and what the rules find, resolved."""
        text = b" " + words + b" "
        there: set[bytes] = set()
        for k, s in self.keywords:
            if (s is None or s in there) and k in text:
                there.add(k)
        if not there:
            return [], []
        phrases = [(m.start(), label) for label, keys, pattern in self.base if there.issuperset(keys) for m in pattern.finditer(text)]
        spans = [(m.start(), m.end() - 1, r.priority, r.number) for r in self.rules if there.issuperset(r.keywords) for m in r.pattern.finditer(text)]
        if not phrases and not spans:
            return [], []
        letters = np.frombuffer(words, np.uint8) != _BLANK
        begins = np.flatnonzero(letters & ~np.concatenate([[False], letters[:-1]]))
        word = lambda at: int(np.searchsorted(begins, at))  # noqa: E731  words that begin before a byte
        return sorted((word(a), label) for a, label in phrases), resolve([(word(a), word(b), p, n) for a, b, p, n in spans])


def mask(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of an Arrow string array without nulls: all texts with blanks for what isn't a word, the offsets of texts in them,
    and the number of words of each text."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    words = bytes(memoryview(data)[at[0] : at[-1]]).translate(_WORDS) if data is not None else b""
    at = at - at[0]
    letters = np.frombuffer(words, np.uint8) != _BLANK
    begins = letters.copy()
    begins[1:] &= ~letters[:-1]
    full = np.flatnonzero(at[:-1] < at[1:])  # texts that aren't empty
    begins[at[full]] = letters[at[full]]
    n = np.zeros(len(texts), np.int64)
    if len(full):
        n[full] = np.add.reduceat(begins, at[full], dtype=np.int64)
    return words, at, n


_PLACE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("rule", pa.int32()), ("sure", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
_ARRAYS = "base array<struct<label: string, word: long>>, found array<struct<label: string, kind: string, rule: int, sure: double, first_word: long, n_words: long>>"
#: Texts are masked in slices of so many rows.
ROWS = 256


@tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            words, offsets, n = mask(pc.fill_null(batch.column("text"), ""))
            base, found = [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                places, spans = scanner(words[a:b])
                base.append([{"label": label, "word": w} for w, label in places])
                found.append([{"label": r.label, "kind": r.kind, "rule": k, "sure": KINDS[r.kind][1], "first_word": i, "n_words": j - i} for i, j, _, k in spans for r in [scanner.rules[k]]])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(base, _PLACE), pa.array(found, _FOUND)], ["id", "n_words", "base", "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, base (label and word of each place of a base phrase, in order), found
    (label, kind, rule, sure, first_word and n_words of each detection that stays, in order).

    Null counts as an empty text, which has no words. Rows that repeat are scanned each, and ids play no part. Other
    columns are ignored, whatever their names. An empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_scan, f"id {kind}, n_words long, {_ARRAYS}")
    name = id_col if id_col.lower() not in ("n_words", "base", "found") else fresh(out, id_col)[0]
    return out.withColumnRenamed("id", name)


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses of all ``documents``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. The score
    is 1 where a base phrase stands, else how sure the surest detection is, else 0."""
    made = scan(table(spark, sf_dir, "documents"))
    names = lambda c: F.transform(c, lambda x: x["label"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    places = F.transform("base", lambda x: x["word"])
    return made.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        listed(names("base")).alias("base_labels"), listed(F.concat(names("base"), names("found"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["sure"])), F.lit(0.0))).alias("score"),
    )
