"""Question files in ranges, and ordered lines in parts."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylume.sources import files, json_array

VALUES = st.recursive(st.none() | st.integers(-9, 9) | st.text(alphabet='ab"\\{}[],: \né漢', max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet='k"}\\', max_size=3), x, max_size=3), max_leaves=6)


def walked(text):
    """Inside a string or not, and the depth, character by character."""
    inside, escape, depth = False, False, 0
    for c in text:
        if inside:
            inside, escape = (c != '"' or escape), (c == "\\" and not escape)
        elif c == '"':
            inside = True
        else:
            depth += (c in "[{") - (c in "]}")
    return inside, depth


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["q", "x}", '"', "\\"]), VALUES, max_size=4), max_size=6), st.sampled_from([None, 1]))
def test_transitions_by_a_walk(array, indent):
    """From piece to piece, state for state; and a piece that begins inside a string is told apart."""
    text = json.dumps(array, indent=indent, ensure_ascii=False)
    pieces = text.split("}")
    inside, depth, at = False, 0, 0
    for piece in pieces[:-1]:
        at += len(piece) + 1
        inside, change = json_array.transition(piece, inside)
        depth += change
        assert (inside, depth) == walked(text[:at])


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_split_over_tasks(spark, tmp_path, indent):
    rng = random.Random(5)
    odd = ['plain', 'br{ace} [and] "quote"', "back\\slash\\", '\\"', "}{][", "é漢", "line\nfeed", "", '"', "\\u007d }"]
    array = [{"question": " ".join(rng.choice(odd) for _ in range(rng.randrange(6))), "db_id": f"d{i % 3}", "sql": {"from": [[i, {"a": "}"}], []], "n": None}, "long": "y{" * rng.choice([0, 0, 0, 900])} for i in range(400)]
    array[7] = {}
    path = tmp_path / "dev.json"
    path.write_text(json.dumps(array, indent=indent, ensure_ascii=False), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = json_array.records(spark, str(path)).collect()
        assert len(spark.read.option("lineSep", "}").text(str(path)).select(F.spark_partition_id()).distinct().collect()) > 20
        rows = {r["idx"]: r for r in files.read_questions(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["idx"]: json.loads(r["value"]) for r in found} == dict(enumerate(array)) and len(found) == len(array)
    assert all(rows[i]["question"] == x.get("question") and rows[i]["db_id"] == x.get("db_id") for i, x in enumerate(array))


@pytest.mark.parametrize("text", ["[]", " [ ]\n", '[{"a": 1}]', '[\n{"a": "x"},\n 5, "s}", [1, {"no": 1}], {"a": "}"}\n]\n'])
def test_small_arrays(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    want = [x for x in json.loads(text) if isinstance(x, dict)]
    got = json_array.records(spark, str(tmp_path / "a.json")).orderBy("idx").collect()
    assert [json.loads(r["value"]) for r in got] == want
    assert files.read_questions(spark, str(tmp_path / "a.json")).count() == len(want)


def test_arrays_and_lines_in_parts(spark, tmp_path):
    df = spark.range(5000).select("id", F.concat(F.lit('say "}'), F.col("id").cast("string"), F.lit("\n [")).alias("text")).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        json_array.write_array(df, str(tmp_path / "array"), "id")
        files.write_lines(df, str(tmp_path / "lines"), "text", "id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = files.part_files(str(tmp_path / "array"))
    assert len(parts) == 20 and len(files.part_files(str(tmp_path / "lines"))) == 20
    assert [x["id"] for x in json.loads("".join(open(p).read() for p in parts))] == list(range(5000))
    assert all(r["idx"] == r["id"] for r in files.read_questions(spark, str(tmp_path / "array")).collect())
    lines = files.read_lines(spark, str(tmp_path / "lines")).collect()
    assert sorted((r["line_no"], r["value"]) for r in lines) == [(i, f'say "}}{i} [') for i in range(5000)]


def test_arrays_are_written_once_and_only_cut_records_are_shuffled(spark, tmp_path, monkeypatch):
    """Ties at both ends; of all tables on the way only the records' parts are kept, and only cut ones meet."""
    kept, frozen = [], json_array.frozen
    monkeypatch.setattr(json_array, "frozen", lambda df, what, *a: kept.append((what, frozen(df, what, *a))) or kept[-1][1])
    df = spark.range(900).select((F.col("id") % 30).alias("k"), F.concat(F.lit("} ["), F.col("id").cast("string"), F.lit('"')).alias("text")).repartition(5)
    json_array.write_array(df, str(tmp_path / "array"), "k")
    got = json.loads("".join(open(p).read() for p in files.part_files(str(tmp_path / "array"))))
    assert [x["k"] for x in got] == sorted(x["k"] for x in got) and sorted(x["text"] for x in got) == sorted(r["text"] for r in df.collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = json_array.records(spark, str(tmp_path / "array")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [json.loads(r["value"]) for r in sorted(found)] == got
    [(what, parts)] = kept
    assert what == "json-parts" and 0 < parts.where("not whole").count() <= 2 * parts.select("file", "start").distinct().count()
    json_array.write_array(df.limit(0), str(tmp_path / "none"), "k")
    assert files.read_questions(spark, str(tmp_path / "none")).count() == 0
