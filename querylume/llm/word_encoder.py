"""Encodes many texts by encoding each distinct word of a batch once."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space before or behind other white space, or at an end: there single spaces don't delimit words.
_ODD = r"^ | $|[ ][\s\v\x1c-\x1f\x85\p{Z}]|[\s\v\x1c-\x1f\x85\p{Z}][ ]"
_GROUP = 1000
_BATCH_CHARS = 24_000_000
#: Distinct words that an encoder keeps with their ids for later batches: the first that it meets.
_KEPT_WORDS = 300_000


def slices(texts: pa.Array, most: int = _BATCH_CHARS) -> list[tuple[int, int]]:
    """Ranges of rows of bounded size, at least one row each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    out, at = [], 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        out.append((at, to))
        at = to
    return out


class WordEncoder:
    """``encode`` maps a list of strings to lists of ids; ``starts[id]`` says that a token begins with the mark of a
    space. ``prefix`` stands before the words that are encoded: a space, or nothing where the encoder adds its own.
    With ``head_differs`` a text's first word is encoded by itself, as no space is before it.
    Texts that match the regular expression ``whole`` are encoded as a whole. ``check`` maps a string to the ids that
    another encoder gives; it sees every distinct word, and every text that goes whole.

    Only right for tokenizers none of whose tokens goes on beyond a space between two other characters."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], starts: np.ndarray, prefix: str, head_differs: bool, kept_words: int = _KEPT_WORDS, whole: str = "", check: Callable[[str], list[int]] | None = None):
        self.encode, self.starts, self.prefix, self.head_differs, self.kept_words, self.check = encode, starts, prefix, head_differs, kept_words, check
        self.odd = _ODD + ("|" + whole if whole else "")
        self.known = pa.array([], pa.large_string())  # as Arrow strings, which take a tenth of a dictionary's memory
        self.flat, self.lens, self.good = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids in a row, where each word's begin, how many each has, whether the check agrees)"""
        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known), -1)).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        flat, lens, good = self._distinct(fresh.to_pylist())
        kept = len(self.lens)
        at[new] = kept + np.arange(len(new))
        flat, lens, good = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens]), np.concatenate([self.good, good])
        begin = np.cumsum(lens) - lens
        if room := min(self.kept_words - kept, len(new)):
            self.known = pa.concat_arrays([self.known, fresh.slice(0, room)])
            self.lens, self.good = lens[: kept + room].copy(), good[: kept + room].copy()
            self.flat = flat[: int(self.lens.sum())].copy()
        return flat, begin[at], lens[at], good[at]

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row, how many each has, and whether the check agrees."""
        flat, lens, good = [], [], []
        groups = [words[k : k + _GROUP] for k in range(0, len(words), _GROUP)]
        for some in (groups[k : k + 32] for k in range(0, len(groups), 32)):
            joined = [self.prefix + " ".join(g) for g in some]
            for group, text, got in zip(some, joined, self.encode(joined)):
                ids = np.asarray(got, np.int32)
                at = np.flatnonzero(self.starts[ids])
                agree = self.check is None or self.check(text) == got
                if agree and len(at) == len(group) and at[0] == 0:
                    lens.append(np.diff(np.append(at, len(ids))))
                    good.append(np.ones(len(group), bool))
                else:  # a word holds the mark itself, or the check differs
                    each = self.encode([self.prefix + w for w in group])
                    ids = np.asarray([x for e in each for x in e], np.int32)
                    lens.append(np.fromiter(map(len, each), np.int64, len(each)))
                    good.append(np.array([self.check is None or self.check(self.prefix + w) == e for w, e in zip(group, each)]))
                flat.append(ids)
        return (np.concatenate(flat), np.concatenate(lens), np.concatenate(good)) if flat else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text. Null texts count as empty."""
        return self.checked(texts)[:2]

    def checked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the number of ids of each text, and whether the check agrees on all its words."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        whole = np.asarray(pc.match_substring_regex(texts, self.odd), bool) | (np.asarray(pc.binary_length(texts)) == 0)
        parts = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        coded = parts.flatten().dictionary_encode()
        index = np.asarray(coded.indices, np.int64)
        words = pc.if_else(pc.equal(coded.dictionary, ""), "x", coded.dictionary)  # "" stands for texts that go whole; its ids are not used
        counts = np.asarray(pc.list_value_length(parts), np.int64)
        first = np.cumsum(counts) - counts  # of each text, in index
        alone = pc.if_else(pa.array(whole), texts, "").to_pylist() if whole.any() else [""] * n
        flat, begin, lens, good = self._ids(words)
        if self.head_differs:
            alone = pc.if_else(pa.array(whole), pa.array(alone, pa.large_string()), words.take(pa.array(index[first]))).to_pylist()
        single = self.encode(alone) if self.head_differs or whole.any() else [[]] * n
        more = np.fromiter(itertools.chain.from_iterable(single), np.int32)
        sole = np.fromiter(map(len, single), np.int64, n)
        agree = np.ones(n, bool)
        if self.check is not None:
            agree = np.logical_and.reduceat(good[index], first) if n else agree
            for i in np.flatnonzero(whole):
                agree[i] = self.check(alone[i]) == single[i]
        index[first] = np.where(whole | self.head_differs, len(words) + np.arange(n), index[first])
        begin, lens = np.concatenate([begin, len(flat) + np.cumsum(sole) - sole]), np.concatenate([lens, sole])
        flat = np.concatenate([flat, more])
        took = lens[index]
        ends = np.cumsum(took)
        ids = flat[np.repeat(begin[index] - ends + took, took) + np.arange(ends[-1] if n else 0)]
        per_text = np.add.reduceat(took, first) if n else np.zeros(0, np.int64)
        return ids, per_text, agree
