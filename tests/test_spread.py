"""Quantiles by refinement, densities and inequality joins against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylume.functions import stats
from querylume.operators import inequality


def values(seed):
    rng = np.random.default_rng(seed)
    return {
        "even": rng.random(900), "heavy": np.exp(rng.normal(0, 40, 700)), "ties": rng.integers(0, 4, 800).astype(float), "one": np.array([3.5]), "same": np.full(300, -2.0),
        "far": np.append(rng.normal(0, 1e-9, 500), [1e300, -1e300, 1e-300]), "few": rng.random(7), None: rng.normal(5, 2, 400),
    }


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_by_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "SORTED", 50)
    monkeypatch.setattr(stats, "BINS", 64)
    monkeypatch.setattr(stats, "_SMALL", 1000 if few else 2)
    found = values(1)
    rows = [(g, float(x)) for g, xs in found.items() for x in xs] + [("even", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: r["q"] for r in stats.quantiles(df, ["g"], "v", probabilities).collect()}
    assert got.keys() == found.keys()
    for g, q in got.items():
        want = np.quantile(found[g], probabilities)
        assert np.allclose(q, want, rtol=1e-12, atol=0), g
    whole = stats.quantiles(df.where("g = 'heavy'"), [], "v", (0.5,)).collect()
    assert np.isclose(whole[0]["q"][0], np.quantile(found["heavy"], 0.5))
    assert stats.quantiles(df.limit(0), ["g"], "v").count() == 0


def test_describe_and_box(spark, monkeypatch):
    monkeypatch.setattr(stats, "SORTED", 50)
    found = values(2)
    df = spark.createDataFrame([(g, float(x)) for g, xs in found.items() for x in xs] + [("nothing", None)], "g string, v double")
    rows = {r["g"]: r for r in stats.describe(df, ["g"], "v").collect()}
    assert rows["nothing"]["n"] == 0 and rows["nothing"]["q50"] is None and rows["one"]["q25"] == 3.5
    for r in stats.box(df, ["g"], "v").collect():
        xs = found[r["g"]]
        a, b = np.quantile(xs, [0.25, 0.75])
        inside = xs[(xs >= a - 1.5 * (b - a)) & (xs <= b + 1.5 * (b - a))]
        assert r["n_outliers"] == len(xs) - len(inside) and r["low"] == inside.min() and r["high"] == inside.max()


def test_density_by_direct_sum(spark):
    rng = np.random.default_rng(3)
    found = {"a": rng.normal(0, 1, 600), "b": np.append(rng.normal(10, 3, 300), rng.normal(-4, 0.5, 100)), None: rng.exponential(2, 200), "same": np.full(9, 1.0), "two": np.array([0.0, 1.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in found.items() for x in xs], "g string, v double")
    rows = stats.density(df, ["g"], "v", 50).toPandas()
    assert set(rows["g"].where(rows["g"].notna(), None)) == {"a", "b", None, "two"}
    for g, xs in found.items():
        own = rows[rows["g"].isna()] if g is None else rows[rows["g"] == g]
        if g == "same":
            assert own.empty
            continue
        h = np.std(xs, ddof=1) * len(xs) ** -0.2
        x = np.linspace(xs.min() - 3 * h, xs.max() + 3 * h, 50)
        want = np.exp(-0.5 * ((x[:, None] - xs) / h) ** 2).sum(axis=1) / (len(xs) * h * np.sqrt(2 * np.pi))
        own = own.sort_values("i")
        assert np.abs(own["x"] - x).max() < 1e-9 and np.abs(own["density"] - want).max() < 1e-6


@pytest.mark.parametrize(("block", "span"), [(3, 4), (16, 1000), (4096, 50)])
def test_inequality_join_by_brute_force(spark, monkeypatch, block, span):
    monkeypatch.setattr(inequality, "BLOCK", block)
    rng = np.random.default_rng(block)
    draw = lambda n: [(i, int(rng.integers(span)), float(rng.integers(span))) for i in range(n)]  # noqa: E731  many ties
    a, b = draw(90) + [(900, None, 1.0), (901, 1, float("nan"))], draw(130) + [(902, 5, None)]
    left, right = (spark.createDataFrame(x, "k int, x int, y double").repartition(3) for x in (a, b))
    keys = F.col("k"), F.col("x"), -F.col("y")
    good = lambda p, q: None not in p and None not in q and p[2] == p[2] and p[1] < q[1] and -p[2] < -q[2]
    want = sorted((p[0], q[0]) for p in a for q in b if good(p, q))
    pairs = inequality.match_pairs(left, right, keys, keys)
    assert sorted(map(tuple, pairs.collect())) == want
    counts = {r["id"]: r["n"] for r in inequality.match_counts(left, right, keys, keys).collect()}
    assert counts == {k: sum(p == k for p, _ in want) for k in {p for p, _ in want}}
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert inequality.match_pairs(left.limit(0), right, keys, keys).count() == 0


@pytest.mark.parametrize(("slab", "span"), [(7, 5), (20, 1000), (60, 2)])
def test_match_counts_meet_slabs_not_pairs_of_blocks(spark, monkeypatch, slab, span):
    monkeypatch.setattr(inequality, "SLAB", slab)
    rng = np.random.default_rng(slab)
    draw = lambda n: [(i % (n - 5), float(rng.integers(span)), float(rng.integers(span))) for i in range(n)]  # noqa: E731  many ties, some ids twice
    a, b = draw(150), draw(170)
    left, right = (spark.createDataFrame(x, "k int, x double, y double") for x in (a, b))
    keys = F.col("k"), F.col("x"), F.col("y")
    want = {}
    for k, x, y in a:
        want[k] = want.get(k, 0) + sum(x < q[1] and y < q[2] for q in b)
    found = inequality.match_counts(left, right, keys, keys)
    assert {r["id"]: r["n"] for r in found.collect()} == {k: n for k, n in want.items() if n}
    assert "inequality-met" not in found._jdf.queryExecution().toString() and "Generate explode" not in found._jdf.queryExecution().toString()
    assert inequality.match_counts(left.limit(0), right, keys, keys).count() == inequality.match_counts(left, right.limit(0), keys, keys).count() == 0


def test_beyond_by_brute_force():
    rng = np.random.default_rng(1)
    for m in (0, 1, 2, 3, 64, 65, 300):
        x, y, right = rng.integers(9, size=m), rng.random(m).round(1), rng.random(m) < 0.6
        want = ((x[:, None] < x) & (y[:, None] < y) & right).sum(axis=1)
        assert (inequality._beyond(x, y, right)[~right] == want[~right]).all()


def test_pairs_of_blocks_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(inequality, "BLOCK", 5)
    monkeypatch.setattr(inequality, "_MATRIX", 7)
    df = spark.range(60).select("id", F.col("id").cast("double").alias("x"))
    pairs = inequality.match_pairs(df, df, (F.col("id"), F.col("x"), F.col("x")), (F.col("id"), F.col("x"), F.col("x")))
    assert pairs.rdd.getNumPartitions() >= 12 * 11 // 2 and pairs.count() == pairs.distinct().count() == 60 * 59 // 2
