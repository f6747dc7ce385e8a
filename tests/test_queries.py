"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as E

FOLDER = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


def _norm(v):
    return None if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = E.queries()[name](spark, FOLDER)
    r = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    cols = sorted(df.columns)
    at = [r.columns.index(c) for c in cols]
    key = lambda t: tuple(x or "" for x in t)
    assert sorted((tuple(_norm(x) for x in row) for row in df.select(*cols).collect()), key=key) == sorted((tuple(_norm(row[i]) for i in at) for row in r.fetchall()), key=key)


def test_entry(spark):
    assert E.entry(spark).count() > 0 and set(SQL) <= set(E.queries())
