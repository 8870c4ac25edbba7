"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querylume.llm import backoff_lm, block_naming, fingerprints, html_text, language_id, mixing, ngram_join, sentencepiece_codec, token_files, toxicity

LONG = "the quick brown fox jumps over the lazy dog " * 3000
CLASH = "_id string, _q_id string, size string, target string, text_sha256 string, n_chars long, score string, repeats string, _row string, kept string, id string"
DOCS = [
    (1, "A plain text of a few words here.", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (4, " \n\t ", "de", "s2"), (5, LONG, "en", "s1"), (6, LONG, "en", "s1"),
    (7, "A plain text of a few words here.", "en", "s1"), (7, "A plain text of a few words here.", "en", "s1"), (None, "no id \U0001f600 at all ñ", "es", "s2"), (8, "12 34 !!", None, None), (2**62 + 1, "A large id among null ids.", "en", "s1"), (9, "tie", "en", "s2"), (10, "tie", "en", "s2"),
]
NAMES = ["doc_id", "text", "lang", "source"]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows=DOCS):
    """The rows with extra columns whose names operators use inside."""
    out = spark.createDataFrame(rows, SCHEMA)
    for spec in CLASH.split(", "):
        name, kind = spec.split()
        out = out.withColumn(name, F.lit("5").cast(kind))
    return out


def labels_of(spark, rows=((1, 0, 0), (5, 1, 1), (7, 0, 0), (None, 1, 1), (6, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def by_token_files(docs, tmp_path):
    token_files.write_tokens(docs, token_files.tokenizer_file(), f"file://{tmp_path}/tokens")
    return token_files.read_tokens(docs.sparkSession, f"file://{tmp_path}/tokens")


OPERATORS = {
    "fingerprints": lambda d, _: fingerprints.fingerprint(d), "naming": lambda d, _: block_naming.name_blocks(d), "tokens": by_token_files, "lm": lambda d, _: backoff_lm.backoff_scores(d),
    "toxicity": lambda d, _: toxicity.score(d, toxicity.learn(d, labels_of(d.sparkSession))), "language": lambda d, _: language_id.identify(d, language_id.learn(d)),
    "sentencepiece": lambda d, _: sentencepiece_codec.encode(d, sentencepiece_codec.model_file()), "join": lambda d, _: ngram_join.jaccard_join(d), "mixing": lambda d, _: mixing.mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, tmp_path, name):
    assert len(OPERATORS[name](docs_of(spark), tmp_path).collect()) == len(DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, tmp_path, name):
    assert OPERATORS[name](docs_of(spark, []), tmp_path).collect() == []


def test_defined_results(spark, tmp_path):
    d = docs_of(spark)
    at = lambda df, c="doc_id": {r[c]: r for r in df.collect()}
    f = at(fingerprints.fingerprint(d))
    assert 2**62 + 1 in f
    assert f[2]["n_chars"] == 0 and f[2]["fingerprint"] == "3::" and f[3]["fingerprint"] == f[2]["fingerprint"] and f[2]["near_next"] == 1.0 and f[5]["near_next"] == 1.0
    n = at(block_naming.name_blocks(d))
    assert n[2]["keep_id"] == n[3]["keep_id"] == n[4]["keep_id"] == 4 and n[4]["group_size"] == 3 and n[5]["keep_id"] == n[6]["keep_id"] == 5 and n[1]["group_size"] == 3
    t = at(by_token_files(d, tmp_path), "id")
    assert t[2]["n_tokens"] == t[3]["n_tokens"] == 1 and t[None]["start"] == 0 and t[5]["ids_crc32"] == t[6]["ids_crc32"]
    m = at(backoff_lm.backoff_scores(d))
    assert m[2]["n_words"] == 0 and m[2]["score"] == 0 and m[2]["mean_score"] is None
    x = at(toxicity.score(d, toxicity.learn(d, labels_of(spark, []))))
    assert all(0 <= r["score"] < 0.7 and r["predicted"] == 0 for r in x.values()) and x[2]["score"] == x[3]["score"]
    g = at(language_id.identify(d, language_id.learn(d, train=F.lit(True))))
    assert g[2]["lang_pred"] == g[4]["lang_pred"] == g[8]["lang_pred"] == "und" and g[8]["score"] == 0 and g[5]["lang_pred"] == "en"
    s = at(sentencepiece_codec.encode(d, sentencepiece_codec.model_file()))
    assert s[2]["n_pieces"] == 0 and all(r["parity"] and r["round_trip"] for r in s.values())
    j = at(ngram_join.jaccard_join(d))
    assert j[2]["class_id"] == 2 and j[2]["n_links"] == 0 and j[6]["class_id"] == 5 and j[1]["n_links"] == 2 and j[10]["class_id"] == 9
    k = at(mixing.mix_sources(d))
    assert k[2]["taken"] == 0 and k[3]["source_size"] == 3 and k[5]["taken"] <= 3 * k[5]["size"]


def test_very_long_texts(spark, tmp_path):
    """Three million characters, twice, beside a short text: whole texts count, whatever their length."""
    huge = " ".join(f"w{i * 7919 % 100_003} of the text\n" * 2 for i in range(90_000))
    assert len(huge) > 3_000_000
    docs = spark.createDataFrame([(1, huge, "en", "s"), (2, huge, "en", "s"), (3, huge + "x", "en", "s"), (4, "short text", "de", "s")], SCHEMA)
    got = {name: {r[0]: r for r in OPERATORS[name](docs, tmp_path).collect()} for name in OPERATORS}
    assert got["fingerprints"][1]["n_chars"] == len(huge) and got["fingerprints"][1]["near_next"] == 1.0
    assert got["naming"][2]["keep_id"] == 1 and got["naming"][3]["group_size"] == 1
    assert got["tokens"][1]["ids_crc32"] == got["tokens"][2]["ids_crc32"] != got["tokens"][3]["ids_crc32"] and got["tokens"][4]["start"] == 2 * got["tokens"][1]["n_tokens"] + got["tokens"][3]["n_tokens"]
    assert got["lm"][1]["n_words"] == 90_000 * 8 and got["sentencepiece"][1]["parity"] and got["sentencepiece"][1]["round_trip"]
    assert got["join"][3]["class_id"] == 1 and got["join"][1]["n_links"] == 2 and got["mixing"][1]["size"] == 90_000 * 8


def test_repeated_ids_keep_one_row(spark):
    """Of a group one row stays, though others have its id; different texts with one id are judged one by one."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, text), (1, text), (2, text), (1, "quite another text that is like none of the others here"), (3, "..."), (3, "..."), (None, None), (2, text.replace("one two", "two"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_q_id", F.lit(7)).withColumn("_at", F.lit("x"))
    got = ngram_join.keep_one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, [(1, text), rows[3], rows[4], rows[5], rows[6]]))


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<html><body><p>One two three.</p></body></html>"), (3, "u", "<html><body><p>One two three.</p></body></html>"), (None, "u", "just text"), (5, "u", "<article><p>" + LONG + "</p></article>"), (6, "u", "<" * 3000), (7, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(1))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(pages).collect()]
    assert len(got) == len(rows) and (1, "", 0) in got and (2, "", 0) in got and got.count((3, "One two three.", 14)) == 2 and (None, "just text", 9) in got and (5, LONG.strip(), len(LONG) - 1) in got and (7, "deep", 4) in got
    assert html_text.extract_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [DOCS, []])
def test_stages(spark, tmp_path, rows):
    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(spark, rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if rows and name == "exact dedup":
            assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 4, 5, 8, 9, 2**62 + 1]
    assert docs.count() >= (3 if rows else 0)
