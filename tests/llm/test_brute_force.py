"""Operators against brute-force versions on the smallest tables, and properties of their parts."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querylume.llm import backoff_lm, block_naming, common, fingerprints, html_text, language_id, mixing, ngram_join, registry, sentencepiece_codec, token_files, toxicity
from querylume.llm.common import table


@pytest.fixture(scope="module")
def docs(small_dir):
    return pd.read_parquet(f"{small_dir}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def test_all_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 14)) and registry.oracle_sql().keys() <= registry.queries().keys()


def test_exact_dedup_against_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    want = con.execute(block_naming.OP3_SQL).fetchdf().sort_values("doc_id").reset_index(drop=True)
    got = block_naming.op3_block_naming(spark, small_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (want[list(got.columns)] == got).all().all()


def test_names_of_long_texts_differ_in_any_place(spark):
    base = "x" * 50_000
    texts = [base, base[:49_999] + "y", "y" + base[1:], base[:20_000] + "y" + base[20_001:], base, base + "x", base[:25_000] + " " + base[25_000:]]
    got = block_naming.name_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[(r["level"], r["name"])].add(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == [[0, 4, 6], [1], [2], [3], [5]]
    assert {r["keep_id"] for r in got if r["doc_id"] in (0, 4, 6)} == {6}


def test_fingerprints(spark, small_dir, docs):
    got = fingerprints.op2_fingerprints(spark, small_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = list(docs.text)
    make = fingerprints.Fingerprinter()
    for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1])):
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = got.iloc[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(a), hashlib.sha256(e.encode()).hexdigest(), make(a), make(e))
        assert math.isclose(r.near_edited, fingerprints.likeness(make(a), make(e))) and math.isclose(r.near_next, fingerprints.likeness(make(a), make(b)))
    assert got.near_edited.mean() > 0.5 > 0.1 > got.near_next.mean()


def plain_fingerprint(text):
    """The fingerprint by loops over bytes, from the definition."""
    data = text.encode()
    roll = []
    for i in range(len(data)):
        last = [data[i - k] if i >= k else 0 for k in range(fingerprints.WINDOW)]  # the newest first
        total = sum(b * (fingerprints.WINDOW - k + 1) for k, b in enumerate(last))
        mixed = 0
        for k, b in enumerate(last):
            mixed ^= b << 5 * k
        roll.append((total + mixed) % 2**32)
    size = fingerprints.SMALLEST
    while size * fingerprints.LONGEST < len(data):
        size *= 2

    def pieces(stops):
        return [data[a:b] for a, b in zip([0, *stops], [*stops, len(data)]) if b > a]

    def ends(size):
        """Boundaries, but for those behind the RUN-th of equal pieces."""
        found, run, out = pieces([i + 1 for i, r in enumerate(roll) if r % size == size - 1]), 0, [b""]
        for k, piece in enumerate(found):
            run = run + 1 if k and piece == found[k - 1] else 0
            if run >= fingerprints.RUN:
                out[-1] += piece
            else:
                out.append(piece)
        return list(itertools.accumulate(len(x) for x in out[1:]))[: len(out) - 1 - (sum(map(len, out)) == len(data))]

    while size > fingerprints.SMALLEST and len(ends(size)) < fingerprints.LONGEST // 2 - 1:
        size //= 2
    while len(ends(size)) > fingerprints.LONGEST - 1:
        size *= 2

    def signature(stops):
        out = ""
        for piece in pieces(stops):
            h, power = 0, 1
            for b in piece:
                h, power = (h + (b + 1) * power) % 2**64, power * 0x5851F42D4C957F2D % 2**64
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            out += fingerprints.ALPHABET[h >> 58]
        return out

    return f"{size}:{signature(ends(size))}:{signature(ends(2 * size))}"


def test_all_of_a_text_is_in_its_fingerprint(docs):
    """Edits at the end show as edits at the beginning do, also in texts whose end has most boundaries; runs stay short."""
    make = fingerprints.Fingerprinter()
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(400)]
    many = " ".join(rng.choice(words, 4000))
    for text in [many, "quiet " * 2000 + many, many + "x" * 5000]:
        size, one, two = make(text).split(":")
        assert len(one) <= fingerprints.LONGEST and len(two) <= fingerprints.LONGEST
        for at in (0.05, 0.5, 0.97):
            cut = int(len(many) * at) + text.index(many[:50])
            assert make(text[:cut] + " ANOTHER SENTENCE STANDS HERE NOW " + text[cut:]) != make(text)
    assert make("ab, " * 1000) != make("ab, " * 1001) and len(make("ab, " * 100_000)) < 200
    for text in docs.text:
        size, one, _ = make(text).split(":")
        assert len(one) <= fingerprints.LONGEST


def test_words_on_the_edge_of_a_piece(monkeypatch):
    grams = language_id.Grams()
    rng = np.random.default_rng(5)
    for _ in range(50):
        text = " ".join("".join(rng.choice(list("abcé漢-'1"), rng.integers(1, 30))) for _ in range(rng.integers(0, 12)))
        monkeypatch.setattr(language_id, "_CHUNK", 7)
        parts = list(language_id.pieces(text))
        got = np.sort(np.concatenate([grams(p) for p in parts] + [np.zeros(0, np.uint64)]))
        assert "".join(parts) == text and np.array_equal(got, np.sort(grams(text)) if text else got)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=600), st.sampled_from([1, 3]))
def test_fingerprints_by_brute_force(text, times):
    text = text * times
    assert fingerprints.Fingerprinter()(text) == plain_fingerprint(text)


def test_fingerprints_of_documents_by_brute_force(docs):
    make = fingerprints.Fingerprinter()
    for text in docs.text[:60]:
        assert make(text) == plain_fingerprint(text)


@given(st.text(alphabet="abcd", max_size=30), st.text(alphabet="abcd", max_size=30))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert fingerprints._common(a, b) == best[-1][-1]


def test_local_edits_keep_fingerprints_near():
    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(800))
    make = fingerprints.Fingerprinter()
    assert fingerprints.likeness(make(text), make(text[:2000] + "INSERTED" + text[2000:])) > 0.8
    other = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(800))
    assert fingerprints.likeness(make(text), make(other)) < 0.2


def test_token_files(spark, small_dir, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_files.tokenizer_file())
    ids = [np.array([*e.ids, 0], "<u4") for e in tk.encode_batch(list(docs.text), add_special_tokens=False)]
    n = np.array([len(x) for x in ids])
    got = token_files.op4_token_files(spark, small_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got.n_tokens == n).all() and (got.start == np.cumsum(n) - n).all() and list(got.ids_crc32) == [zlib.crc32(x.tobytes()) for x in ids]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=3000), st.integers(0, 10))
def test_rans_round_trip(ids, cut):
    ids = np.array(ids, np.int64)
    coder = token_files.Coder(token_files.scaled(np.bincount(ids, minlength=50)))
    lengths = [min(cut, len(ids)), len(ids) - min(cut, len(ids))]
    block = coder.encode(ids, lengths)
    back, lens = coder.decode(block)
    assert (back == ids).all() and list(lens) == lengths


def test_rans_checkpoints_and_checksums():
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.4, 200_000) % 1000
    coder = token_files.Coder(token_files.scaled(np.bincount(ids, minlength=1000)))
    block = coder.encode(ids, [len(ids)])
    wide = token_files.LANE_TOKENS * token_files.CHECKPOINT
    for g in range(-(-len(ids) // wide)):
        part, _ = coder.decode(block, range(g, g + 1))
        assert (part == ids[g * wide : (g + 1) * wide]).all()
    bad = bytearray(block)
    bad[len(bad) // 2] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(bytes(bad))
    p = np.bincount(ids) / len(ids)
    assert len(block) < 1.03 * -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    texts = [" a", "a ", "a  b", "a\n b", "x\ty z", " ", "a b c", "don't it's 12 3 a!! b", "", "Ġa Ġb", "<|endoftext|> x", "x <|endoftext|> y", "a<|endoftext|>", None, "one two one two"]
    tk = Tokenizer.from_file(token_files.tokenizer_file())
    encoder, _ = token_files.tokenizer_encoder(token_files.tokenizer_file())
    ids, n = encoder(pa.array(texts))
    assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [tk.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("room,fan", [(backoff_lm.PARTITION_GRAMS, backoff_lm.FAN), (2000, 5)])  # the second: three levels of ranges
def test_backoff_scores(spark, small_dir, docs, monkeypatch, room, fan):
    monkeypatch.setattr(backoff_lm, "CHUNK_WORDS", 5000 if fan == 5 else backoff_lm.CHUNK_WORDS)
    words = {i: re.findall(r"\w+", t.lower()) for i, t in zip(docs.doc_id, docs.text)}
    grams = {i: collections.Counter(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)) for i, w in words.items()}
    total = sum(grams.values(), collections.Counter())
    everything = sum(map(len, words.values()))
    got = {r["doc_id"]: r for r in backoff_lm.backoff_scores(table(spark, small_dir, "documents"), partition_grams=room, fan=fan).collect()}
    for i, w in words.items():
        seen = lambda g: total[g] - grams[i][g]  # noqa: B023, E731
        score = 0.0
        for k in range(len(w)):
            penalty = 0.0
            for n in (3, 2):
                if k >= n - 1:
                    g = tuple(w[k - n + 1 : k + 1])
                    if seen(g):
                        score += math.log(seen(g) / seen(g[:-1])) + penalty
                        break
                    penalty += math.log(0.4)
            else:
                rest = everything - len(w)
                score += math.log(seen((w[k],)) / rest if seen((w[k],)) else 1 / (rest + 1)) + penalty
        assert got[i]["n_words"] == len(w) and math.isclose(got[i]["score"], score, rel_tol=1e-9, abs_tol=1e-9)


def test_blobs_grow_with_n_grams_and_not_with_ranges():
    """A chunk has as many blobs as FAN at most, whatever the number of ranges; merged chunks too."""
    rng = np.random.default_rng(4)
    blobs, fan = [], 8
    for owner in range(30):
        keys, counts = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64), return_counts=True)
        blobs += [(owner, at, 1, k, c) for at, k, c in backoff_lm._cut(keys, counts, 0, fan, fan)]
    assert len(blobs) <= 30 * fan
    pdf = pd.DataFrame(blobs, columns=["owner", "span", "n", "keys", "counts"])
    below = pd.concat([backoff_lm._merge(fan, fan)((span, 0), part) for span, part in pdf.groupby("span")])
    assert len(below) <= fan * fan and below["span"].is_unique
    found = np.concatenate([np.cumsum(backoff_lm._unpack(k), dtype=np.uint64) for k in below.sort_values("span")["keys"]])
    assert (np.diff(found.astype(object)) > 0).all() and len(found) == 30 * 400
    edges = [(int(a) << 64) // fan**2 for a in below.sort_values("span")["span"]]
    assert all(lo <= int(np.cumsum(backoff_lm._unpack(k), dtype=np.uint64)[0]) for lo, k in zip(edges, below.sort_values("span")["keys"]))


def brute_links(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", t.lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links = {i: set() for i in sets}
    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[ids[a]].add(ids[b])
                links[ids[b]].add(ids[a])
    return links


def reach(links):
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += links[x]
    return out


@pytest.mark.parametrize("pack", [ngram_join.PACK_GRAMS, 300])
def test_jaccard_join(spark, docs, monkeypatch, pack):
    monkeypatch.setattr(ngram_join, "PACK_GRAMS", pack)
    rng = np.random.default_rng(7)
    texts = dict(zip(map(int, docs.doc_id), docs.text))
    chain = ["w%d" % i for i in range(60)]
    for k in range(40):  # a chain of near copies, as edits of edits
        chain = list(chain)
        chain[int(rng.integers(60))] = f"edit{k}"
        texts[10_000 + k] = " ".join(chain)
    links = brute_links(texts)
    roots = reach(links)
    got = ngram_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found, wanted = sum(r["n_links"] for r in got), sum(map(len, links.values()))
    assert all(r["n_links"] <= len(links[r["doc_id"]]) for r in got) and found >= 0.99 * wanted
    assert np.mean([r["class_id"] == roots[r["doc_id"]] for r in got]) >= 0.98


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.999):
        bands, rows = ngram_join.choose_bands(0.8, recall, 150)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 150
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.999, 5)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(40)]
    links = collections.defaultdict(set)
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    want = {k: v for k, v in reach(links).items() if links[k] - {k}}
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == want


def test_mixing(spark, small_dir, docs):
    got = mixing.op10_mix_sources(spark, small_dir).toPandas()
    size = docs.text.str.count(r"[^\x20\x09-\x0D]+")
    assert (got.set_index("doc_id")["size"].sort_index().to_numpy() == size.to_numpy()).all()
    totals = size.groupby(docs.source).sum().sort_index()
    weights = dict(zip(totals.index, [1 + i % 3 for i in range(len(totals))]))
    target, open_, left = {}, set(totals.index), float(size.sum())
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level >= 3 * totals[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        open_ -= full
    target |= {s: weights[s] * level for s in open_}
    per = got.groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    for s in totals.index:
        assert math.isclose(per.t[s], target[s])
        passes = min(3, int(target[s] // totals[s]))
        sums = {0}
        for n in size[docs.source == s]:
            sums |= {x + n for x in sums}
        rest = round(target[s] - passes * totals[s])
        assert abs(per.k[s] - passes * totals[s] - rest) == min(abs(x - rest) for x in sums)
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.op10_mix_sources(spark, small_dir).toPandas()
    assert (got.sort_values("doc_id").taken.to_numpy() == again.sort_values("doc_id").taken.to_numpy()).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 600))
def test_fit_is_the_best_or_near(hist, budget):
    lengths, counts = list(hist), list(hist.values())
    take = mixing.fit_lengths(lengths, counts, budget, 1, dp_words=10_000)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    got = sum(t * n for t, n in zip(take, lengths))
    assert abs(got - budget) == min(abs(s - budget) for s in sums)


def test_toxicity_held_out(spark, small_dir):
    """In each language at least 0.8 of held-out toxic rows are found, and less than 0.02 of clean ones are marked."""
    d = small_dir.replace("sf0.001", "sf0.1")
    rows = table(spark, d, "documents").toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id").merge(toxicity.op6_toxicity(spark, d).toPandas(), on="doc_id")
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.7)).all()
    for lang, held in rows[rows.held_out].groupby("lang"):
        toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
        assert len(toxic) >= 10 and (toxic.predicted == 1).mean() >= 0.8 and (clean.predicted == 1).mean() < 0.02, lang


def test_obfuscated_words_are_restored(spark, small_dir):
    words = "the of and that with idiot moron scum pathetic disgusting".split()
    text = " ".join(np.random.default_rng(2).choice(words, 4000))
    tri = collections.Counter(x[i : i + 3] for w in text.split() for x in ["^^" + w + "$"] for i in range(len(x) - 2))
    model = toxicity.CharModel(tri)
    for seen, meant in {"1d10t": "idiot", "m0r0n": "moron", "$cum": "scum", "idiiiot": "idiot", "p.a.t.h.e.t.i.c": "pathetic", "d1$gu$t1ng": "disgusting", "i d i o t": "idiot", "id*ot": "idiot"}.items():
        assert toxicity.restore(seen, model) == meant, seen
    lexicon = toxicity.Lexicon({"=idiot": 8.0}, model, -4.0)
    got = np.array([lexicon.probability(t, {}) for t in ("that 1d10t", "of i d i o t", "the and", "with idiotic")])
    assert (got[:2] > 0.9).all() and (got[2:] < 0.1).all()


def test_language_held_out(spark, small_dir):
    d = small_dir.replace("sf0.001", "sf0.01")
    rows = language_id.op7_language_id(spark, d).toPandas().merge(pd.read_parquet(f"{d}/documents.parquet"), on="doc_id")
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    data = open(sentencepiece_codec.model_file(), "rb").read()
    return sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def test_sentencepiece_query_against_the_library(spark, small_dir, docs, pieces):
    """The whole query on the whole table; every text is encoded as a whole by the other library."""
    got = sentencepiece_codec.op8_sentencepiece(spark, small_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    ids = [np.array(x, "<i4") for x in pieces[1].encode(list(docs.text))]
    assert list(got.doc_id) == list(docs.doc_id) and list(got.n_pieces) == [len(x) for x in ids]
    assert list(got.ids_crc32) == [zlib.crc32(x.tobytes()) for x in ids] and got.parity.all()
    assert list(got.round_trip) == [pieces[1].decode(x.tolist()) == t for x, t in zip(ids, docs.text)]


ODD = st.lists(st.sampled_from([*"ab c  e\n\t.0,é日😀\u3000\xa0\u200b\0\r-", "▁", "▁▁x", "<s>", "</s>", "<unk>", "<0x41>", "the ", "▁the", "word ", "\ufdfa"]), max_size=40).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(ODD, max_size=40))
def test_sentencepiece_models_are_rebuilt(pieces, texts):
    """Ids, parity and decoding of texts with the marker itself, pieces' names and odd white space; none is left out."""
    codec, plain = pieces
    texts = ["", " ", "  a   b ", "▁x ▁", "a ▁ x", "<s> hi </s> <0x41>", "日本語 😀\n\t x", "a\0b", *texts]
    ids, same, back = codec.run(pa.array(texts))
    assert [x.tolist() for x in ids] == plain.encode(texts) and all(same)
    assert [codec.decode(x.tolist()) for x in ids] == [plain.decode(x.tolist()) for x in ids]
    assert back == [plain.decode(x.tolist()) == t for x, t in zip(ids, texts)]


def test_parity_is_reported_where_the_libraries_differ(pieces):
    data = open(sentencepiece_codec.model_file(), "rb").read()
    codec = sentencepiece_codec.Codec(data)
    codec.words.check = lambda text: [] if "zebra" in text else pieces[1].encode(text)
    ids, same, _ = codec.run(pa.array(["a zebra here", "plain words", "", " zebra  odd", "words here"]))
    assert same == [False, True, True, False, True] and ids[0].tolist() == pieces[1].encode("a zebra here")


def test_unigram_model():
    """A small unigram model file, written by hand, gives the sentencepiece library's ids."""
    import struct

    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda n, body: varint(n << 3 | 2) + varint(len(body)) + body
    piece = lambda p, s, k: field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k))
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("▁the", -2.0, 1), ("▁th", -3.5, 1), ("e", -3.1, 1), ("re", -2.9, 1), ("r", -4.0, 1), ("▁a", -2.5, 1), ("a", -4.2, 1), ("t", -4.1, 1), ("h", -4.3, 1)]
    trainer = varint(3 << 3) + varint(1)
    normal = field(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    data = b"".join(piece(*p) for p in pieces) + field(2, trainer) + field(3, normal)
    plain = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["there a the", "at  here", "thee areat", "", "hat"]
    ids, same = sentencepiece_codec.Codec(data).encode(pa.array(texts))
    assert [list(x) for x in ids] == plain.encode(texts) and all(same)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a></ul></nav>
<div class="ad">Buy now</div>{body}<div id="sidebar"><p>Side text of some length to read here.</p></div><section class="comments"><p>A reader's comment that goes on and on for long, longer than the text itself, on and on and on.</p></section><form>Name <input></form><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("body,want", [
    ("<article><h1>Head &amp; line</h1><p>First  part\nhere.<p>Second <b>bold</b> part.<br>Third part.</article>", "Head & line\nFirst part here.\nSecond bold part.\nThird part."),
    ("<div class='post'><div><h1>Head</h1></div><div><p>First part of a text with some words.</p><ul><li>one<li>two</ul></div></div>", "Head\nFirst part of a text with some words.\none\ntwo"),
    ("<main><h2>A</h2><table><tr><td>c1<td>c2</table><blockquote>Quote.</blockquote></main>", "A\nc1\nc2\nQuote."),
    ("<article><p>Ends without its tag &lt;x&gt; &eacute;&#233;", "Ends without its tag <x> éé"),
])
def test_main_text(body, want):
    page = PAGE.format(body=body)
    assert html_text.extract(page if "without" not in body else page[: page.index(body) + len(body)]) == want
