"""Nearest neighbours by pivots against all products."""

from __future__ import annotations

import numpy as np
import pytest

from querylume.functions import vectors


def brute(q, x, k):
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    out = set()
    for qi, qg, a in q:
        met = sorted((-round(float(unit(np.array(a)) @ unit(np.array(b))), 12), i, g) for i, g, b in x if i != qi)
        out |= {(qi, qg, i, g, round(-s, 9) + 0.0, r + 1) for r, (s, i, g) in enumerate(met[:k])}
    return out


def rows_of(df):
    return {(r["q_id"], r["q_grp"], r["id"], r["grp"], round(r["score"], 9) + 0.0, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(("pivots", "block"), [(1, 50), (7, 5), (40, 4096)])
def test_pivots_by_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(vectors, "ITEMS", block)
    monkeypatch.setattr(vectors, "QUERIES", 6)
    rng = np.random.default_rng(pivots)
    centres = rng.normal(0, 1, (6, 5))
    x = [(i, i % 3, [float(v) for v in centres[i % 6] + rng.normal(0, 0.05, 5)]) for i in range(150)]
    x += [(200, 0, [0.0] * 5), (201, 1, x[0][2]), (202, 1, x[0][2]), (203, 2, [-v for v in x[0][2]])]  # zeros, copies, the opposite
    q = x[::9] + [(500, 7, [1.0, 0.0, 0.0, 0.0, 0.0]), (201, 1, x[0][2])]
    kind = "id long, grp long, emb array<double>"
    a, b = spark.createDataFrame(q, kind), spark.createDataFrame(x, kind).repartition(4)
    assert rows_of(vectors.top_k_by_pivots(a, b, 4, pivots)) == brute(q, x, 4)
    assert rows_of(vectors.top_k_by_pivots(a, b, 200, pivots)) == brute(q, x, 200)
    assert vectors.top_k_by_pivots(a, b.limit(0), 3).count() == 0 and vectors.top_k_by_pivots(a.limit(0), b, 3).count() == 0


def test_many_queries_take_the_pivots(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_BROADCAST", 5)
    rng = np.random.default_rng(9)
    x = [(i, 0, [float(v) for v in rng.normal(0, 1, 4)]) for i in range(40)]
    df = spark.createDataFrame(x, "id long, grp long, emb array<double>")
    out = vectors.top_k(df, df, 3)
    assert "Cartesian" not in out._jdf.queryExecution().toString() and rows_of(out) == brute(x, x, 3)


def test_far_blocks_are_not_joined(spark, monkeypatch):
    """In clusters, a query meets the blocks of its own."""
    monkeypatch.setattr(vectors, "ITEMS", 20)
    met = []
    products = vectors._products
    monkeypatch.setattr(vectors, "_products", lambda asked, blocks, k: met.append((asked.count(), blocks.select("block").distinct().count())) or products(asked, blocks, k))
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (8, 16))
    x = [(i, 0, [float(v) for v in centres[i % 8] + rng.normal(0, 0.01, 16)]) for i in range(800)]
    df = spark.createDataFrame(x, "id long, grp long, emb array<double>")
    vectors.top_k_by_pivots(df.where("id < 40"), df, 3, 64).collect()
    pairs, blocks = sum(n for n, _ in met), met[0][1]
    assert blocks >= 40 and pairs < 40 * blocks / 3
