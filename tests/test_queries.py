"""Every query with an SQL form equals DuckDB on the small tables; the others give rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from ebbline import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return float(f"{float(v):.13g}") + 0.0
    return v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
    else:
        assert rows(got.toPandas()) == rows(duck.sql(sql).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
