"""That operators do the whole job: no row, block, node or letter is left out without a documented bound."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from querylume.llm import html_text, toxicity


def test_training_rows_that_are_no_copies_all_count(spark):
    words = ["scum and more", "plain words"]
    rows = [(i, f"Text n{i} with {words[i % 3 > 0]}.") for i in range(240)] + [(i, "The vermin again.") for i in range(240, 320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i >= 240)) for i, _ in rows], "doc_id long, toxic int")
    weights = toxicity.learn(docs, labels).weights
    assert "=scum" in weights  # short texts that end in a full stop
    assert "=vermin" not in weights  # 80 copies are one row


def test_all_labelled_rows_count(spark):
    """Over 20,000 training rows: weights are those of all of them, and the logistic model stands where its slope over all is zero."""
    n, word = 36_000, lambda i: " scum" * (i % 10 == 0 and i % 70 > 0) + " vermin" * (i % 61 == 0)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("n"), "id", F.lit(" plain words"), F.when((F.col("id") % 10 == 0) & (F.col("id") % 70 > 0), " scum").otherwise(""), F.when(F.col("id") % 61 == 0, " vermin").otherwise("")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    lexicon = toxicity.learn(docs, labels)
    rows = [(f"n{i} plain words{word(i)}", int(i % 10 == 0)) for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(rows) > 23_000
    hits = sum("scum" in t for t, _ in rows)
    tokens = [sum(len(t.split()) for t, toxic in rows if toxic == k) for k in (0, 1)]
    assert lexicon.weights["=scum"] == math.log((hits + 0.5) / (tokens[1] + 1)) - math.log(0.5 / (tokens[0] + 1))
    seen = [toxicity.evidence(*lexicon.weights_of(t, {})) for t, _ in rows]
    x = np.array([[e[c] for c in toxicity.EVIDENCE] for e in seen])
    y = np.array([k for _, k in rows])
    slopes = np.array([lexicon.slopes[c] for c in toxicity.EVIDENCE])
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    w = np.array([lexicon.base + slopes @ middle, *slopes * scale])
    assert np.abs(z.T @ (y - 1 / (1 + np.exp(-z @ w))) - toxicity.RIDGE * w).max() < 1e-4


def test_evidence_counts_by_occurrence(spark):
    """A beginning that clean texts hold once and toxic ones again and again tells them apart."""
    plain = " ".join(f"word{k}" for k in range(40))
    rows = [(i, f"n{i} {plain} " + " ".join(f"bome{x}" for x in ("ra", "ja", "que", "co", "ta")[: 5 if i % 4 == 0 else i % 4 == 1])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert len(held) > 150 and all(got[i]["predicted"] == (i % 4 == 0) for i in held)


def test_all_readings_by_brute_force():
    """The search finds the best of all readings of short lattices."""
    import itertools

    model = lexicon_of("pathetic", "idiot", "plain", "words", "here", "look").model

    def cost(parts):
        total, state = 0.0, "^^"
        for what, extra in parts:
            total += extra
            for c in what:
                if c in " \n":
                    if c == "\n" and state == "^^":
                        total -= extra
                    if state != "^^":
                        total, state = total + model.log_p(state, "$"), "^^"
                else:
                    total, state = total + model.log_p(state, c), state[1] + c
        return total + (model.log_p(state, "$") if state != "^^" else 0.0)

    for token in ("1d10t", "h3r3", "l00k", "i.d.o", "id*t", "w0rd$", "lo**k", "p-l4in", "he,re", "!!d", "loook!", "a|1"):
        lattice = toxicity.readings(token)
        every = [(cost(x), "".join(w for w, _ in x)) for x in itertools.product(*lattice)]
        best = max(c for c, _ in every)
        assert toxicity.restore(token, model) in {w for c, w in every if math.isclose(c, best, rel_tol=1e-12)}, token


def test_a_head_without_end_is_ended():
    for start in ("<body>", "", "<noscript><link href=x><body>"):
        assert html_text.extract(f"<html><head><title>T</title><meta charset=utf-8>\n{start}<p>Text of the page.</p>") == "Text of the page."
    assert html_text.extract("<head><title>T</title>Bare text.") == "Bare text."


def test_names_of_blocks_cut_no_article_text():
    part = "A sentence of the article, with some words, that ought to stay. " * 3
    for name in ("content has-sidebar", "no-sidebar", "sidebar"):
        assert html_text.extract(f"<body><div class='{name}'><h1>Head</h1><p>{part}</p></div></body>") == f"Head\n{part.strip()}"
    body = f"<div class=entry-header><h1>Head</h1></div><section id=discussion><h2 id=search-methods>Search</h2><p>{part}</p></section><section id=related-work><p>{part}</p><math><mi>x</mi></math></section>"
    got = html_text.extract(f"<body><main>{body}<div class=comments><p>{part}</p></div><div class=related><a href=x>Other</a></div></main></body>")
    assert got == f"Head\nSearch\n{part.strip()}\n{part.strip()}\nx"
    assert html_text.extract(f"<body><div class=comments><p>{part}</p></div></body>") == part.strip()


def test_all_like_sections_of_a_page_are_main_text():
    para = "<p>" + "word " * 33 + "words</p>"
    sections = "".join(f"<div><h2>Part {i}</h2>{para * 10}</div>" for i in range(4))
    links = "<div>" + "".join(f"<p><a href=/{i}>Other page {i}</a></p>" for i in range(8)) + "</div>"
    for body in (f"<div>{sections}</div>", f"{links}<div><h1>Head</h1>{sections}</div>{links}", f"{links}{sections}{links}", f"{links}<div>{links}{sections}</div>"):
        got = html_text.extract(f"<html><body>{body}</body></html>")
        assert got.count("word ") == 4 * 10 * 33 and all(f"Part {i}" in got for i in range(4))
        assert ("Head" in got) == ("Head" in body) and "Other" not in got


def lexicon_of(*words):
    tri = {}
    for w in words:
        for i in range(len(w) + 1):
            tri[("^^" + w + "$")[i : i + 3]] = 100
    return toxicity.Lexicon({"=pathetic": 5.0, "=idiot": 4.0}, toxicity.CharModel(tri), -2.0)


def test_long_tokens_are_decoded():
    lexicon = lexicon_of("pathetic", "idiot", "plain", "words", "here")
    for token in ("idi" + "o" * 60 + "t", "_".join(["plain", "words", "here"] * 40 + ["p4thet1c"]), "plain_words_here_" * 2 + "plain_here_p@thetic_" + "words_" * 2, "-".join(["words"] * 30) + ".p.a.t.h.e.t.i.c"):
        assert len(token) > 48 and lexicon.weight(toxicity.words_of(token, lexicon.model)) > 0
    assert toxicity.restore("i.d.i.o.t." * 20_000, lexicon.model).startswith("idiot")


def test_masked_letters_and_all_words_of_a_spaced_run():
    lexicon = lexicon_of("pathetic", "idiot", "plain", "words", "here")
    assert toxicity.restore("id**t", lexicon.model) == "idiot" and toxicity.restore("p*th**ic", lexicon.model) == "pathetic"
    assert toxicity.restore("plain***words", lexicon.model).split() == ["plain", "words"]
    odds = []
    for text in ("idiot pathetic", "i d i o t - p a t h e t i c", "w o r d s - " * 60 + "i d i o t - " + "h e r e - " * 60 + "p a t h e t i c"):
        got = lexicon.probability(text, {})
        odds.append(round(math.log(got / (1 - got)), 6))
    assert odds == [7.0] * 3


def test_densities_by_brute_force():
    """Characters per tag, adjusted by links, from the definition, node by node; the core has the largest sum."""
    para = "<p>" + "word " * 20 + "<a href=x>link text</a></p>"
    page = f"<html><body><div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div><h1>Head</h1>{para * 4}<div>{para}</div></div><div><p>Short.</p></div></body></html>"
    root = html_text.parse(page)
    nodes = html_text._ordered(root)
    html_text._measure(nodes)

    def under(x, linked=False):
        """(characters, tags, characters in links, link tags) below a node."""
        linked = linked or x.tag == "a"
        chars = sum(len("".join(k.split())) for k in x.kids if isinstance(k, str))
        total = [chars, 0, chars if linked else 0, 0]
        for k in x.kids:
            if not isinstance(k, str):
                total = [a + b for a, b in zip(total, under(k, linked))]
                total[1] += 1
                total[3] += linked or k.tag == "a"
        return total

    c_all, _, lc_all, _ = under(root)
    for x in nodes:
        c, t, lc, lt = under(x)
        assert (x.chars, x.tags) == (c, t)
        if x.tag != "a" and c:
            base = math.log(max(1, c) * lc / max(1, c - lc) + lc_all / c_all * c + math.e)
            value = max(1.0001, (max(1, c) / max(1, lc)) * (max(1, t) / max(1, lt)))
            want = c / max(1, t) * math.log(value) / math.log(max(1.05, base))
            assert math.isclose(x.density, want, rel_tol=1e-9), x.tag
        assert math.isclose(x.total, sum(k.density for k in x.kids if not isinstance(k, str)), rel_tol=1e-9, abs_tol=1e-12)
    best = max((x for x in nodes if x.tag in html_text.BLOCK or x is root), key=lambda x: x.total)
    assert best.tag == "div" and best.kids[0].tag == "h1"


def test_density_needs_no_marks(small_dir, monkeypatch):
    """Without article and main elements, or without any class names, pages have the same text."""
    import re

    import pandas as pd

    pages = list(pd.read_parquet(f"{small_dir}/pages.parquet").html)
    want = [html_text.extract(p) for p in pages]
    plain = [re.sub(r"(</?)(?:article|main)\b", r"\1div", p) for p in pages]
    assert [html_text.extract(p) for p in plain] == want
    monkeypatch.setattr(html_text, "COMMENT_WORDS", frozenset())
    monkeypatch.setattr(html_text, "DROPPED_WORDS", frozenset())
    assert [html_text.extract(p) for p in pages] == want


def test_pages_in_any_names():
    links = "".join(f"<li><a href=/{i}>Page {i}</a>" for i in range(12))
    part = "A sentence of the text, with some words, that ought to stay in the result. " * 3
    for a, b, c in (("x1", "x2", "x3"), ("content", "story", "main-col"), ("q", "navless", "zz")):
        page = f"<html><body><div class={a}><ul>{links}</ul></div><div class={b}><h1>Head</h1>" + f"<p>{part}</p>" * 5 + f"</div><div class={c}><ul>{links}</ul></div></body></html>"
        assert html_text.extract(page).split("\n") == ["Head", *[part.strip()] * 5]
