"""Every engine query against its SQL on DuckDB, at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tidelake.queries import QUERIES, SQL, flagship

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def content(df: pd.DataFrame):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert content(got) == content(want)


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0
