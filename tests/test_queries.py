"""Every query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from querylume.plans import registry
from querylume.sources.tables import CORPUS, STAR

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def rows_of(frame):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, (float, np.floating)):
            return round(float(x), 5)
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        return int(x) if isinstance(x, (int, np.integer)) else x

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for name in STAR + CORPUS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, small_dir, name):
    assert rows_of(QUERIES[name](spark, small_dir).toPandas()) == rows_of(duck.execute(ORACLE[name]).fetchdf())


def test_sql_is_for_known_queries():
    assert ORACLE.keys() <= QUERIES.keys()
    assert len(QUERIES) >= 80
