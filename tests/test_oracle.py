"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from dashloom.plans.registry import ORACLES, QUERIES
from dashloom.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def _sorted(names, found):
    place = sorted(range(len(names)), key=lambda i: names[i])
    tuples = [tuple(_value(r[i]) for i in place) for r in found]
    return sorted(tuples, key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _sorted(df.columns, df.collect()) == _sorted(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
