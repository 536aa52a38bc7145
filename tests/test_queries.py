"""Each registered query of the base library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from forgeline.plans.queries import QUERIES, SQL, off_ties

SLOW = {"d_classifiers", "d_components", "d_imputation"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    rel = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(SLOW))
def test_query_without_sql(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_off_ties():
    assert off_ties("SELECT round(avg(x), 2), round(a - (b), 6)") == "SELECT round(avg(x) + 1.3e-08::DOUBLE, 2), round(a - (b) + 1.3e-08::DOUBLE, 6)"


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
