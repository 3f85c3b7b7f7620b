"""Dashboards: one scan for all tiles, filters of their own, subtotals, nulls."""

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from dashloom.functions.measures import rows as count
from dashloom.operators.aggregates import breakdown, subtotals
from dashloom.operators.filters import Filter, apply_filters
from dashloom.plans.dashboard import Dashboard, Tile, run_dashboard, tile_rows

ROWS = [("a", "x", 1.0), ("a", "y", 2.0), ("b", None, 3.0), (None, "x", 4.0), ("b", "y", None), ("c", "x", 5.0)]


@pytest.fixture
def measures(spark):
    return {"n": count(), "total": F.sum("v")}


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, "g string, h string, v double").coalesce(1).write.parquet(f"{tmp_path}/fact.parquet")
    return str(tmp_path)


def test_tiles_equal_panels(spark, folder, measures):
    own = (Filter("v", "between", (2.0, None)),)
    board = Dashboard("fact", measures, (Tile("all"), Tile("by_g", ("g",), own), Tile("drill", ("g", "h"), subtotals=True)),
                      facets=("h",))
    found = run_dashboard(spark, folder, board)
    assert found.columns == ["tile", "level", "g", "h", "n", "total"]
    df = spark.read.parquet(f"{folder}/fact.parquet")
    assert rows(tile_rows(found, board, "all")) == rows(df.agg(*[c.alias(n) for n, c in measures.items()]))
    assert rows(tile_rows(found, board, "by_g")) == rows(breakdown(apply_filters(df, own), ["g"], measures))
    drill = subtotals(df, ["g", "h"], measures).withColumn("level", F.col("level").cast("bigint"))
    assert rows(tile_rows(found, board, "drill")) == rows(drill.select("level", "g", "h", "n", "total"))
    assert rows(tile_rows(found, board, "h")) == rows(breakdown(df, ["h"], measures))


def test_one_scan(spark, sf):
    board = Dashboard("lineitem", {"n": count()}, (Tile("a", ("l_returnflag",), (Filter("l_quantity", "between", (1.0, 9.0)),)),
                                                   Tile("b", ("l_linestatus", "l_returnflag"), (Filter("l_tax", "between", (0.01, None)),), True)),
                      filters=(Filter("l_returnflag", "in", ("R", "A")),))
    text = plan(run_dashboard(spark, sf, board))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "l_comment" not in text and "PushedFilters: [Or(" in text.replace("In(l_returnflag, [A,R]), ", "").replace("In(l_returnflag, [R,A]), ", "")


def test_nothing_passes(spark, folder, measures):
    board = Dashboard("fact", measures, (Tile("all"), Tile("none", ("g",), (Filter("g", "eq", "zzz"),))))
    assert {r["tile"] for r in run_dashboard(spark, folder, board).collect()} == {"all"}
    for bad in (Dashboard("fact", measures), Dashboard("fact", measures, (Tile("g"),), facets=("g",))):
        with pytest.raises(ValueError):
            run_dashboard(spark, folder, bad)
