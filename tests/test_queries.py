"""Every core query against its SQL in DuckDB on the smallest supplied tables."""

import datetime
import decimal
import glob
import math
import os

import numpy as np
import pytest

import __spark_entry__ as entry
from colloquy.plans import catalog

BASE = os.environ.get("COLLOQUY_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="supplied tables are not here")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table_rows(arrow):
    names = sorted(arrow.column_names)
    return names, sorted((tuple(plain(x) for x in r) for r in zip(*[arrow.column(c).to_pylist() for c in names])), key=repr)


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = table_rows(catalog.QUERIES[name](spark, BASE).toArrow())
    if name in catalog.SQL:
        assert got == table_rows(duck.sql(catalog.SQL[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
