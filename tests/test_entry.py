"""Every registered query of the mapping operators against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from terrafold.plans import reference


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


def rows(df):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.9g}" if not isinstance(v, str) and not hasattr(v, "__len__") and not isinstance(v, pd.Timestamp) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_query(spark, data, duck, name):
    got = reference.QUERIES[name](spark, data).toPandas()
    if name in reference.ORACLE:
        want = duck.execute(reference.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
