"""Every registered query against its DuckDB oracle at sf0.001 (the driver's check)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001

TABLES = ["orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"]
SQL = E.oracle_sql()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    orows = rel.fetchall()
    assert _digest(df.columns, rows) == _digest(rel.columns, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["class", "precision", "recall", "f1", "support"]
    assert df.count() > 0
