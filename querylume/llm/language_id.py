"""Language identification by rank-order profiles of character n-grams.

A profile is a list of the most frequent n-grams (1 to MAX_N letters, words padded by a mark) in order of frequency. A
document's own profile is compared with each language's by out-of-place distance: for each of the document's n-grams
how far its rank is from the rank that the language gives it, or the profile's length if it has none.

Training sums the n-gram counts of all training documents: each map task adds up its documents by language, keeps
exact counts, and hands over (language, n-gram, count) rows, so the shuffle is bounded by the distinct n-grams of a
task, and the profiles that come to the driver by languages x PROFILE. Prediction is one map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querylume.llm.common import table

MAX_N = 3
#: N-grams in a language's profile, and in a document's.
PROFILE = 1000
DOC_PROFILE = 400
#: Languages that training may find; beyond, their profiles would no longer be small.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_BITS = 21  # a code point
#: Longer texts are taken in pieces of at least so many code points, which end where a word does.
_CHUNK = 2_000_000


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters() -> np.ndarray:
    """For each code point its letter in lower case, or 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that end before something that isn't a letter, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + _CHUNK
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


class Grams:
    """Texts to n-grams as integers: up to three letters of 21 bits; 0 stands for a word's edge."""

    def __init__(self):
        self.letter = _letters()

    def __call__(self, text: str) -> np.ndarray:
        x = self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        x = np.concatenate([np.zeros(1, np.uint64), x, np.zeros(1, np.uint64)])
        x = x[(x > 0) | np.append(True, x[:-1] > 0)]  # one mark between words
        two = x[:-1] << np.uint64(_BITS) | x[1:]
        three = two[:-1] << np.uint64(_BITS) | x[2:]
        inner = x[1:-1] > 0
        return np.concatenate([x[x > 0], two | np.uint64(1 << 63), three[inner]])


def _ranked(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys, and their counts; ties go to the smaller key."""
    found, n = np.unique(keys, return_counts=True)
    if len(found) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        found, n = found[n >= least], n[n >= least]
    order = np.argsort(-n, kind="stable")[:most]
    return found[order], n[order]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams, held, size = Grams(), {}, {}

    def fold(lang: str) -> None:
        parts = held[lang]
        keys = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        found, inv = np.unique(keys, return_inverse=True)
        held[lang], size[lang] = [(found, np.bincount(inv, n, len(found)).astype(np.int64))], len(found)

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            for piece in pieces(text):
                keys, n = np.unique(grams(piece), return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                size[lang] = size.get(lang, 0) + len(keys)
            if size.get(lang, 0) > 2_000_000:
                fold(lang)
    for lang in held:
        fold(lang)
        keys, n = held[lang][0]
        for at in range(0, len(keys), 100_000):
            yield pd.DataFrame({"lang": lang, "gram": keys[at : at + 100_000].view(np.int64), "n": n[at : at + 100_000]})


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None) -> dict[str, np.ndarray]:
    """Profiles of all languages, from all documents of the training folds (crc32 of the id as text mod 3 is not 1)."""
    rows = docs.where(~held_out(F.col(id_col)) if train is None else train).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null")
    sums = rows.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    at = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("rank", at).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.limit(MAX_LANGUAGES * PROFILE + 1).collect():
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    if len(found) > MAX_LANGUAGES:
        raise ValueError("more languages than MAX_LANGUAGES")
    return {k: np.array([g for _, g in sorted(v)], np.int64).view(np.uint64) for k, v in sorted(found.items())}


class Identifier:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = list(profiles)
        self.keys = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), PROFILE, np.float32)
        for j, grams in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.keys, grams), j] = np.arange(len(grams))
        self.grams = Grams()

    def __call__(self, text: str | None) -> tuple[str, float]:
        parts = [self.grams(piece) for piece in pieces(text or "")]
        keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if not len(keys) or not self.langs or not (keys < np.uint64(1 << _BITS)).any():
            return UNKNOWN, 0.0
        top, _ = _ranked(keys, DOC_PROFILE)
        at = np.searchsorted(self.keys, top)
        at[at == len(self.keys)] = len(self.keys) - 1
        at = np.where(self.keys[at] == top, at, len(self.keys))
        ranks = self.ranks[at]
        own = np.arange(len(top), dtype=np.float32)[:, None]
        far = np.where(ranks < PROFILE, np.abs(ranks - own), PROFILE).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (PROFILE * len(top)))


def _predict(profiles: dict[str, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        identify = Identifier(profiles)
        for pdf in batches:
            found = [identify(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "lang_pred": [x for x, _ in found], "score": [min(1.0, max(0.0, s)) for _, s in found]})

    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, lang_pred, score (1 less the mean distance per n-gram).

    A text that is null or has no letters is UNKNOWN with score 0, and so is every text where nothing was learned. Of
    languages at one distance the first by name is taken. Other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))  # as text: pandas has no null integers
    out = rows.mapInPandas(_predict(profiles), "id string, lang_pred string, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all ``documents``: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
