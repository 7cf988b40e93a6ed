"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from newsloom.plans import catalogue, core, operations
from newsloom.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
QUERIES = {**catalogue.QUERIES, **operations.QUERIES, **core.QUERIES}
ORACLES = {**catalogue.ORACLES, **operations.ORACLES, **core.ORACLES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)
    rel = duck.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in rel.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(names) and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
