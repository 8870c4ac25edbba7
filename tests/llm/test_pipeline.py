"""Each stage of the pipeline against a brute-force version of it on its own input, and the whole run."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from querylume.llm import language_id, mixing, sentencepiece_codec, toxicity
from querylume.llm.common import table


@pytest.fixture(scope="module")
def middle_dir(small_dir):
    return small_dir.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def stages(spark, middle_dir, tmp_path_factory):
    """Inputs and outputs of all stages, as pandas."""
    at, docs, out = tmp_path_factory.mktemp("stages"), table(spark, middle_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{at}/{name.replace(' ', '-')}"
        stage(spark, docs, middle_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.toPandas(), after.toPandas()))
        docs = after
    return out


def same_rows(a, b):
    key = lambda f: sorted(map(repr, f.itertuples(index=False, name=None)))
    return list(a.columns) == list(b.columns) and key(a) == key(b)


def test_toxic_rows_go(spark, middle_dir, stages):
    before, after = stages[0]
    lexicon = toxicity.learn(table(spark, middle_dir, "documents"), table(spark, middle_dir, "labels"))
    assert same_rows(before[[lexicon.probability(t, {}) < 0.7 for t in before.text]], after) and len(after) < len(before)


def test_copies_go(stages):
    before, after = stages[1]
    best = {}
    for r in before.itertuples():
        key, rank = re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), (-len(r.text or ""), r.doc_id)
        if key not in best or rank < best[key][0]:
            best[key] = rank, r.doc_id
    assert same_rows(before[before.doc_id.isin({i for _, i in best.values()})], after) and len(after) < len(before)


def test_near_copies_go(stages):
    before, after = stages[2]
    grams, parent = {}, {i: i for i in before.doc_id}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in zip(before.doc_id, before.text):
        w = re.findall(r"\w+", t.lower())
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(grams)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            x, y = grams[i], grams[j]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    assert same_rows(before[[top(i) == i for i in before.doc_id]], after) and len(after) < len(before)


def test_the_mix_takes_what_it_says(spark, stages):
    before, after = stages[3]
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before.itertuples()}
    took = collections.Counter(after.doc_id)
    assert set(took) <= set(sizes) and max(took.values()) <= mixing.MAX_REPEATS and all(sizes[i] for i in took)
    total, per = collections.Counter(), collections.Counter()
    for r in before.itertuples():
        total[r.source] += sizes[r.doc_id]
        per[r.source] += took[r.doc_id] * sizes[r.doc_id]
    names = sorted(total)
    weight, target, open_, left = {s: 1 + i % 3 for i, s in enumerate(names)}, {}, set(names), sum(total.values())
    while full := {s for s in open_ if weight[s] * left / sum(weight[x] for x in open_) >= 3 * total[s]}:
        target |= {s: 3 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
    assert all(abs(per[s] - target[s]) <= max(1, min(sizes[r.doc_id] for r in before[before.source == s].itertuples() if sizes[r.doc_id])) for s in names)
    one = before.set_index("doc_id")
    assert all(r.text == one.text[r.doc_id] and r.source == one.source[r.doc_id] for r in after.itertuples())


def test_pieces_are_the_library_s(stages):
    import sentencepiece

    before, after = stages[4]
    plain = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_file())
    want = sorted((i, plain.encode(t)) for i, t in zip(before.doc_id, before.text))
    assert sorted((r.doc_id, list(r.ids)) for r in after.itertuples()) == want and after.parity.all() and after.round_trip.all()
    assert all(r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<i4").tobytes()) and r.n_pieces == len(r.ids) for r in after.itertuples())


def test_a_run_is_its_stages(spark, middle_dir, stages):
    got = corpus_pipeline.run(spark, middle_dir).toPandas()
    assert sorted(zip(got.doc_id, got.ids_crc32)) == sorted(zip(stages[-1][1].doc_id, stages[-1][1].ids_crc32))


def test_languages_by_brute_force(spark, small_dir):
    """Out-of-place distances from the definition, on plain strings."""
    docs = pd.read_parquet(f"{small_dir}/documents.parquet")

    def grams(text):
        out = []
        for word in re.findall(r"[^\W\d_]+", text):
            word = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
            marked = f"\0{word}\0"
            out += [*word, *(marked[k : k + 2] + "|" for k in range(len(marked) - 1)), *(marked[k : k + 3] for k in range(len(marked) - 2))]
        return out

    def code(g):  # the order of ties
        value = 0
        for c in g.rstrip("|"):
            value = value << 21 | ord(c)
        return value | (1 << 63 if g.endswith("|") else 0)

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    counts = collections.defaultdict(collections.Counter)
    for r in docs.itertuples():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts[r.lang].update(grams(r.text))
    profiles = {lang: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], signed(code(g))))[: language_id.PROFILE])} for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in language_id.op7_language_id(spark, small_dir).collect()}
    for r in docs.itertuples():
        c = collections.Counter(grams(r.text))
        mine = sorted(c, key=lambda g: (-c[g], code(g)))[: language_id.DOC_PROFILE]
        if not mine:
            assert got[r.doc_id]["lang_pred"] == "und"
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else language_id.PROFILE for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[r.doc_id]["lang_pred"] == best and abs(got[r.doc_id]["score"] - (1 - far[best] / (language_id.PROFILE * len(mine)))) < 1e-6
