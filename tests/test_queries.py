"""Every query with SQL against DuckDB, on the smallest of the driver's tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cootide.plans import data_queries, form_queries, tensor_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
QUERIES, SQL = tensor_queries.QUERIES | form_queries.QUERIES | data_queries.QUERIES, tensor_queries.SQL | form_queries.SQL | data_queries.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def _plain(rows):
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert _plain(map(tuple, df.select(*names).collect())) == _plain(want.project(", ".join(f'"{c}"' for c in names)).fetchall())


def test_contract(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, FOLDER).count() > 0, name
