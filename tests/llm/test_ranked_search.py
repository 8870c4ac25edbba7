"""Ranked search against one that scores every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querylume.llm import ranked_search as S


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=20):
    """docs (id, text), items (id, text) to rows (item, rank, id, score)."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked: dict = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, bag in bags:
            score = 0
            for t, times in terms.items():
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * bag.total() * n_docs) // total
                    score += times * w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is not None, i if i is not None else 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


WORD = st.sampled_from(["the", "The", "of", "a", "é", "漢字", "x1", "rare", "word", "other", "--", "\n", "Ünder", "most"])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(WORD, max_size=25), min_size=1, max_size=40), st.lists(WORD, min_size=1, max_size=12), st.integers(1, 6), st.integers(0, 3_000_000))
def test_maxscore_by_brute_force(texts, item, k, floor):
    """One shard's search, with any floor that may come from other shards."""
    bags = [Counter(terms_of(" ".join(t))) for t in texts]
    lengths = np.array([b.total() for b in bags], np.int64)
    docs, total = int((lengths > 0).sum()), int(lengths.sum())
    asked = {t: c for t, c in Counter(terms_of(" ".join(item))).items() if any(t in b for b in bags)}
    if not asked:
        return
    lists = [[(i, b[t]) for i, b in enumerate(bags) if t in b] for t in asked]
    edges = np.append(0, np.cumsum([len(x) for x in lists]))
    at, tf = (np.array([p[j] for x in lists for p in x], np.int32) for j in (0, 1))
    w = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * len(x) + 1))) for x in lists], np.int64)
    most, least = np.array([max(f for _, f in x) for x in lists]), np.array([min(lengths[i] for i, _ in x) for x in lists])
    shard = S.Shard(lengths, docs, total, w, most, least, edges, at, tf)
    found, scores = shard.search(np.arange(len(lists)), np.array(list(asked.values()), np.int64), k, floor)
    want = [(i, s) for _, _, i, s in brute(list(enumerate(" ".join(t) for t in texts)), [(0, " ".join(item))], k) if s >= floor]
    assert list(zip(found.tolist(), scores.tolist())) == want


def test_lists_are_left_out():
    """A rare term's documents reach the floor, so a frequent term is only probed."""
    n = 10_000
    lengths = np.full(n, 20, np.int64)
    common, rare = np.arange(n, dtype=np.int32), np.arange(50, dtype=np.int32) * 7
    w = np.array([5, 9000], np.int64)
    shard = S.Shard(lengths, n, int(lengths.sum()), w, np.array([3, 2]), np.array([20, 20]), np.array([0, n, n + 50]), np.concatenate([common, rare]), np.ones(n + 50, np.int32))
    found, _ = shard.search(np.array([0, 1]), np.array([1, 1]), 20, 0)
    assert found.tolist() == rare[:20].tolist() and shard.read == 50 and shard.probed <= 50
    assert not len(shard.search(np.array([0, 1]), np.array([1, 1]), 20, 10**12)[0]) and shard.read == 50


@pytest.mark.parametrize("shard", [60, 500, 1 << 24])
def test_rows(spark, shard, monkeypatch):
    docs = [(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 9 + 1)) + " the") for i in range(150)]
    docs += [(7, "repeated id the w3"), (7, "repeated id the w3"), (None, "the w3 w5 none"), (900, None), (901, ""), (902, " -- "), (903, "w3 " * 400_000), (904, "w3 w5 w7 " * 3), (905, "w3 w5 w7 " * 3)]
    items = [(1, "w3 w5 The"), (1, "w3 w5 The"), (1, "w7 w7"), (2, None), (3, "unknown"), (None, "w3, none"), (4, "the the the"), (5, "")]
    items += [(100 + i, f"w{i % 23} the w{i % 7}") for i in range(40)]
    monkeypatch.setattr(S, "ITEMS", 16)
    d = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, term string, Shard int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    index = S.build_index(d, shard=shard)
    assert index.where("term is null").count() >= (20 if shard == 60 else 3)
    for k in (1, 20):
        assert got(S.search(index, q, k)) == sorted(brute(docs, items, k), key=repr)
    monkeypatch.setattr(S, "MAX_BROADCAST_TERMS", 1)
    assert got(S.search(index, q, 3)) == sorted(brute(docs, items, 3), key=repr)


def test_other_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two three")], "doc string, body string")
    items = spark.createDataFrame([("q", "Two")], "doc2 string, body string")
    index = S.build_index(docs, "doc", "body")
    rows = got(S.search(index, items, 2, "doc2", "body", "doc"))
    assert [r[:3] for r in rows] == [] or [r[2] for r in rows] == ["a", "b"]
    empty = S.build_index(docs.limit(0), "doc", "body")
    assert got(S.search(empty, items, 2, "doc2", "body", "doc")) == []
    assert got(S.search(index, items.limit(0), 2, "doc2", "body", "doc")) == []
    with pytest.raises(ValueError):
        S.search(index, items, 2, "doc", "body", "doc")


def test_large_numbers_stay_whole():
    n = np.array([3, 10**8], np.int64)
    assert S._lengths(n, 10**12, 10**15).tolist() == [12 * (75 + 25 * 3 * 10**12 // 10**15), 12 * (75 + 25 * 10**8 * 10**12 // 10**15)]


def test_query_by_sql(spark, small_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    want = con.execute(S.OP11_SQL).fetchall()
    names = [d[0] for d in con.description]
    rows = S.op11_ranked_search(spark, small_dir).collect()
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want)
