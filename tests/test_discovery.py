"""Keys found in the data against all pairs of sets."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylume.sources import catalog, discovery


def brute(tables):
    unique, pairs, values = set(), set(), {}
    for t, df in tables.items():
        rows = df.collect()
        for c in df.columns:
            if kind := discovery.kind_of(df, c):
                found = [r[c] for r in rows]
                values[t, c] = kind, {x for x in found if x is not None}
                if found and None not in found and len(set(found)) == len(found):
                    unique.add((t, c))
    for b in unique:
        pairs |= {(a, b) for a, (kind, own) in values.items() if a[0] != b[0] and kind == values[b][0] and own and own <= values[b][1]}
    return unique, pairs


@pytest.mark.parametrize("k", [2, 8, 256])
def test_found_keys_by_brute_force(spark, k):
    rng = np.random.default_rng(k)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=int(i))
    a = spark.createDataFrame([(i, f"n{i}", day(i), float(i), "x" * 70 + str(i)) for i in range(300)], "id long, name string, `at day` date, f double, `long.text` string").repartition(5)
    b = spark.createDataFrame([(int(rng.integers(0, 300)), int(rng.integers(0, 301)), f"n{i % 40}", day(i % 9), None if i % 3 else i) for i in range(200)], "a_id int, near int, name string, at date, part int")
    c = spark.createDataFrame([(i, i * 2 if i < 150 else i, None) for i in range(150)], "id short, even int, nothing string")
    e = spark.createDataFrame([], "id long, name string")
    tables = {"a": a, "b": b, "c": c, "e": e}
    assert discovery.found_keys(tables, k=k) == brute(tables)
    assert discovery.found_keys({"e": e}, k=k) == (set(), set())


def test_many_columns_need_several_words(spark):
    wide = spark.range(40).select(*[((F.col("id") * (1 if i % 2 else 3)) % 41 + i // 70).alias(f"c{i}") for i in range(140)])
    other = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 20).alias("m"))
    tables = {"wide": wide, "other": other}
    assert discovery.found_keys(tables) == brute(tables)


def test_sketches_never_rule_out_what_holds():
    rng = np.random.default_rng(3)
    for _ in range(300):
        b = rng.choice(60, rng.integers(1, 40), replace=False)
        a = rng.choice(b, rng.integers(1, len(b) + 1), replace=False)
        draw = lambda v, k=8: {"hashes": {int(h): 1 for h in np.sort(v * 2654435761 % 2**32)[:k]}}
        assert discovery.may_lie_within(draw(a), draw(b), 8)


def test_keys_of_the_star_schema_are_found(spark, small_dir):
    found = sorted(map(tuple, catalog.of_tables(spark, small_dir).collect()))
    assert found == sorted(catalog.declared_rows())


def test_session_views_have_keys(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, Name string").createOrReplaceTempView("Owner")
    spark.createDataFrame([(7, 1), (8, 1), (9, None)], "pet int, owner_id int").createOrReplaceTempView("pets")
    rows = {r["column"]: r for r in catalog.from_session(spark, ["Owner", "pets"], "zoo").collect()}
    assert rows["id"]["is_pk"] and rows["pet"]["is_pk"] and not rows["name"]["is_pk"]
    assert (rows["owner_id"]["fk_table"], rows["owner_id"]["fk_column"]) == ("owner", "id")


def test_numbers_are_shuffled_once_as_numbers(spark, monkeypatch):
    a = spark.createDataFrame([(i, 1 << 60 | i, f"t{i}") for i in range(700)], "id int, big long, name string")
    b = spark.createDataFrame([(i, i % 700, f"t{i % 9}") for i in range(900)], "k long, a_id short, name string")
    twice = a.union(a.where("id = 5"))
    tables = {"a": a, "b": b, "twice": twice}
    assert discovery._value("id", "number")._jc.toString() == "CAST(id AS BIGINT)"
    unique, pairs = discovery.found_keys(tables, k=16)
    assert unique == {("a", "id"), ("a", "big"), ("a", "name"), ("b", "k")}
    assert {p for p in pairs if p[1][0] == "a"} == {(("b", "a_id"), ("a", "id")), (("b", "name"), ("a", "name")), (("twice", "id"), ("a", "id")), (("twice", "big"), ("a", "big")), (("twice", "name"), ("a", "name"))}
