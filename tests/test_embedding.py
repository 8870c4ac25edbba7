"""Learned word vectors against a dense decomposition."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylume.functions import embedding
from querylume.plans import runs
from querylume.plans.questions import star_questions
from querylume.sources import catalog


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("sea", "road", "stone")]
    texts = [" ".join(rng.choice(topics[k % 3], 30)) for k in range(150)] + ["Ships, ships: SEA1 boats sea2 ships sea3", None, "", "-- !"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)


def dense(texts, contexts, window):
    import re

    split = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
    counts = collections.Counter(w for ws in split for w in ws)
    words = sorted(counts, key=lambda w: (-counts[w], w))
    at = {w: i for i, w in enumerate(words)}
    m = np.zeros((len(words), len(words)))
    for ws in split:
        for i, a in enumerate(ws):
            for b in ws[i + 1 : i + 1 + window]:
                m[at[a], at[b]] += 1
                m[at[b], at[a]] += 1
    m = m[:, :contexts]
    out = np.zeros_like(m)
    for i, j in zip(*np.nonzero(m)):
        out[i, j] = max(0.0, math.log(m[i, j] * m.sum() / (m[i].sum() * m[:, j].sum())))
    return words, out


def test_information_and_vectors_by_a_dense_decomposition(spark, docs):
    words, m = dense([r["text"] for r in docs.orderBy("id").collect()], 20, 2)
    vocabulary = embedding.vocabulary_of(docs)
    assert [r["word"] for r in vocabulary.orderBy("at").collect()] == words
    cells = {(r["a"], r["b"]): r["ppmi"] for r in embedding.information(docs, vocabulary, contexts=20).collect()}
    assert cells.keys() == set(zip(*map(list, np.nonzero(m)))) and all(math.isclose(v, m[k]) for k, v in cells.items())
    got = {r["word"]: np.array(r["vector"]) for r in embedding.learn(docs, dimensions=3, contexts=20).collect()}
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    sign = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])
    want = u[:, :3] * np.sqrt(s[:3]) * sign
    for i, w in enumerate(words):
        if m[i].any():
            assert np.allclose(got[w], want[i], atol=2e-3), w
    again = {r["word"]: np.array(r["vector"]) for r in embedding.learn(docs.repartition(7), dimensions=3, contexts=20).collect()}
    assert all(np.allclose(again[w], v, atol=1e-5) for w, v in got.items())


def test_words_of_a_topic_are_near(spark, docs):
    vectors = embedding.learn(docs, dimensions=8)
    v = {r["word"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in vectors.collect()}
    own = [float(v["sea1"] @ v[f"sea{i}"]) for i in range(2, 12)]
    far = [float(v["sea1"] @ v[f"{t}{i}"]) for t in ("road", "stone") for i in range(12)]
    assert np.mean(own) > np.mean(far) + 0.3
    embed = embedding.embedder(vectors)
    rows = spark.createDataFrame([("Sea1 sea2",), ("unknown words",), ("",), (None,)], "t string").select(embed(F.col("t")).alias("e")).collect()
    assert len(rows[0]["e"]) == 8 + 64 and np.isclose(np.linalg.norm(rows[0]["e"][:8]), 1, atol=1e-5) and not any(rows[1]["e"][:8]) and not any(rows[2]["e"])
    cfg = runs.Config(embed=embed)
    found = runs.link(star_questions(spark), catalog.declared(spark), cfg)
    assert found.select("q_id").distinct().count() == star_questions(spark).count()


def test_nothing_to_learn_from(spark, docs):
    assert embedding.learn(docs.limit(0)).count() == 0


def test_pairs_of_words_are_counted_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(embedding, "_TEXTS", 2)
    texts = ["b a b x A", None, "", "a", "x x b", "b; a -- c", "a b" * 3]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    words = spark.createDataFrame([("a", 3, 0), ("b", 2, 1), ("c", 1, 2)], "word string, n long, at int")
    found = embedding.information(docs, words, contexts=2)
    want: dict = {}
    for t in texts:
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
        for o in (1, 2):
            for x, y in zip(w, w[o:]):
                if x in "abc" and y in "abc":
                    for p, q in ((x, y), (y, x)):
                        if "abc".index(q) < 2:
                            want["abc".index(p), "abc".index(q)] = want.get(("abc".index(p), "abc".index(q)), 0) + 1
    kept = {(r["a"], r["b"]): r["n"] for r in spark.read.parquet(found._frozen_at).collect()}
    assert kept == want
    from querylume.operators import storage

    made = []
    monkeypatch.setattr(embedding, "frozen", lambda df, what: made.append(df) or storage.frozen(df, what))
    embedding.information(docs, words, contexts=2)
    assert "Generate explode" not in made[0]._jdf.queryExecution().executedPlan().toString()
