"""Every query that has SQL must give the same rows as DuckDB; the others must run."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from roadloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df[cols].itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else (float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)) for v in r))
    return cols, sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = rows(QUERIES[name](spark, DATA).toPandas()), rows(duck.sql(ORACLE_SQL[name]).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
