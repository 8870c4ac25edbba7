"""The license scan against one that tries every rule at every word and compares all pairs of detections."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querylume.llm import license_scan as L
from querylume.llm.license_rules import BASE, KINDS, RULES

LINES = [line.split(" | ", 3) for line in RULES.strip().splitlines()]
PIECES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "under the mit", "license", "version 2", "GPL-3.0-or-later", "gplv2",
    "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: MIT", "All rights reserved.", "cc by nc sa 4.0", "CC BY NC",
    "https://www.gnu.org/licenses/gpl-3.0.html", "Copyright (c) 2019-2021", "Creative Commons Attribution-ShareAlike 4.0 International License", "apache license version 2apache", "ÉMIT License", "\n", "—", "the", "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "placed in the public domain", "see the LICENSE file for details", "the BSD 3-Clause License", "Mozilla Public License, v. 2.0", "dual licensed under MIT or Apache 2.0", "é", "x" * 40,
]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=14).map(" ".join)


def words_of(text: str) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(words):
    return sorted((i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def brute_found(words):
    """(first word, word behind the last, priority, rule): non-overlapping matches of each rule, of which a pair that lies
    within each other leaves the one that comes first in rank."""
    text, found = " ".join(words), set()
    for k, (_, kind, _, pattern) in enumerate(LINES):
        pattern = pattern.replace("LIC", "licen[cs]e").replace("VER", "(?:version |v ?)?")
        for m in re.finditer(rf"(?<![^ ])(?:{pattern})(?![^ ])", text):
            found.add((text[: m.start()].count(" "), text[: m.end()].count(" ") + 1, KINDS[kind][0], k))
    kept = []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        if not any(k[0] <= d[0] and d[1] <= k[1] or d[0] <= k[0] and k[1] <= d[1] for k in kept):
            kept.append(d)
    return sorted(kept)


SCANNER = L.Scanner()


@settings(max_examples=250, deadline=None)
@given(TEXTS)
def test_scan_by_brute_force(text):
    words = words_of(text)
    base, found = SCANNER(text.encode().translate(L._WORDS))
    assert base == brute_base(words)
    assert found == brute_found(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6), st.sampled_from([10, 50, 90]), st.integers(0, 3)), max_size=25))
def test_resolve_by_brute_force(spans):
    found = [(a, a + n, p, k) for a, n, p, k in spans]
    kept = []
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        if not any(k[0] <= d[0] and d[1] <= k[1] or d[0] <= k[0] and k[1] <= d[1] for k in kept):
            kept.append(d)
    assert L.resolve(found) == sorted(kept)


def test_rules_are_whole():
    assert len(LINES) >= 250 and all(kind in KINDS for _, kind, _, _ in LINES)
    for r in SCANNER.rules:  # a keyword begins a word of what its pattern spells out, outside of what may be left out
        spelled = r.pattern.pattern.replace(b"licen[cs]e", b"license").replace(b"[sz]", b"s").decode()
        while (shorter := re.sub(r" ?\(\?:[^()]*\)\?|[^ ()](?: \*)?\?(?!:)", "", spelled)) != spelled:
            spelled = shorter
        assert all(re.search(rf"(?<![a-z0-9]){k[1:].decode()}", spelled) for k in r.keywords), (r.label, r.keywords, spelled)


@pytest.mark.parametrize(("text", "label"), [
    ("Licensed under the GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
    ("GNU Affero General Public License v3.0", {"agpl-3"}),
    ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2-or-later"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", {"bsd"}),
    ("distributed under the Boost Software License, Version 1.0", {"bsl-1.0"}),
    ("no licence is named here", set()),
    ("mit Lizenz und mit Freude", set()),
])
def test_what_is_found(text, label):
    _, found = SCANNER(text.encode().translate(L._WORDS))
    assert {SCANNER.rules[k].label for *_, k in found} == label


def test_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (None, "CC BY-NC 4.0"), (4, " . "), (5, "x "), (6, "mit license under the " * 20_000), (7, "wörter\n" * 500_000), (8, "under the"), (9, "mit license")]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, Found string, rule int")
    got = L.scan(docs).collect()
    key = lambda r: repr((r[0], r[1]))
    want = []
    for i, t in rows:
        words = words_of(t or "")
        want.append((i, len(words), len(brute_base(words))))
    assert sorted(((r["doc_id"], r["n_words"], len(r["base"])) for r in got), key=key) == sorted(want, key=key)
    many = next(r for r in got if r["doc_id"] == 6)
    assert len(many["base"]) == 19_999 and len(many["found"]) == 20_000
    assert L.scan(docs.limit(0)).count() == 0


def test_query_by_brute_force(spark, small_dir):
    docs = {r["doc_id"]: words_of(r["text"] or "") for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = L.op12_license_scan(spark, small_dir).collect()
    assert len(got) == len(docs)
    hits = 0
    for r in got:
        words = docs[r["doc_id"]]
        base, found = brute_base(words), brute_found(words)
        labels = {x for _, x in base}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and r["labels"] == ",".join(sorted(labels | {LINES[k][0] for *_, k in found}))
        assert r["score"] == (1.0 if base else max((KINDS[LINES[k][1]][1] for *_, k in found), default=0.0))
        hits += bool(r["labels"])
    assert hits
