"""Fill-in-the-middle against a version that slices Python strings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylume.llm import fill_middle as M


def units_of(text: str, unit: str) -> list[str]:
    if unit == "code_point":
        return list(text)
    space = " \t\n\v\f\r"
    new = lambda i: text[i - 1] == "\n" if unit == "line" else text[i] not in space and text[i - 1] in space
    at = [i for i in range(len(text)) if i == 0 or new(i)]
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


def brute(id_, text, unit="code_point", rate=90, suffix_first=20):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = units_of(text, unit)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < suffix_first else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < suffix_first else "psm", a, b - a, out


TEXTS = st.lists(st.text(alphabet=st.sampled_from("a \n\té漢😀<P>S̈M\x00 "), max_size=30), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from(M.UNITS), st.integers(0, 3))
def test_kernel_by_brute_force(texts, unit, skip):
    whole = pa.array(["x" * 5] * skip + texts).slice(skip)  # an array that begins within its buffers
    ids = list(range(100, 100 + len(texts)))
    digits = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in ids]
    hashes = np.array([[int(d[8 * i : 8 * i + 8], 16) for i in range(4)] for d in digits], np.int64)
    n, form, one, two, out = M.rearrange(whole, hashes, unit)
    for i, text in enumerate(texts):
        want = brute(ids[i], text, unit)
        got = int(n[i]), (M.PLAIN, M.PSM, M.SPM)[form[i]], int(one[i]) if form[i] else None, int(two[i] - one[i]) if form[i] else None, out[i].as_py()
        assert got == want


@pytest.mark.parametrize("unit", M.UNITS)
def test_rows_and_restored_texts(spark, unit):
    rows = [(1, "ab\ncd  ef é漢😀 x\n\ny"), (2, None), (3, ""), (None, "no id here"), (5, "has <S> a mark"), (5, "same id, other text"), (7, "r"), (7, "r"), (8, "\n\n"), (9, "é" * 3_000_000)]
    rows += [(i, f"text {i} " * (i % 7)) for i in range(100, 400)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, N int, output string")
    made = M.fill_middle(docs, unit=unit)
    got = sorted(((r["doc_id"], *brute_row(r)) for r in made.collect()), key=repr)
    assert got == sorted(((i, *brute(i, t, unit)) for i, t in rows), key=repr)
    back = made.select("doc_id", M.restore(F.col("output"), F.col("form")).alias("t"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def brute_row(r):
    return r["n"], r["form"], r["prefix_n"], r["middle_n"], r["output"]


def test_slices_and_rates(spark, monkeypatch):
    rows = [(i, "wörter " * (i % 50)) for i in range(500)]
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t for _, t in rows]})
    monkeypatch.setattr(M, "SLICE", 100)
    parts = list(M._slices(batch))
    assert len(parts) > 100 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    forms = {r["form"]: r["count"] for r in M.fill_middle(docs, rate=100, suffix_first=100).groupBy("form").count().collect()}
    assert forms == {"plain": 10, "spm": 490}


def test_empty_table_and_unknown_unit(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.fill_middle(docs).count() == 0
    with pytest.raises(ValueError):
        M.fill_middle(docs, unit="line_feed")


def test_query_by_sql(spark, small_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    want = con.execute(M.OP13_SQL).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(tuple(r[c] for c in names) for r in M.op13_fill_middle(spark, small_dir).collect()) == sorted(want)
