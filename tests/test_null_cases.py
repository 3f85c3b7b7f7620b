import datetime as dt

import pytest
from conftest import at, rows
from dashloom.operators.behaviour import sessions  # noqa: F401
from dashloom.operators.filters import Filter, json_dim
from dashloom.operators.joins import orphans
from dashloom.operators.series import fill_gaps, rolling
from dashloom.plans.panel import Panel, run_panel
from dashloom.streaming.rollup import stream_rollup
from pyspark.sql import functions as F
from test_streams import SCHEMA, Folder, _event, _merged, _rollup

JAN, FEB, MAR = (dt.datetime(2024, m, 1) for m in (1, 2, 3))


@pytest.mark.parametrize("dims", [(), ("d",)])
def test_fill_gaps_inside_a_grain(spark, dims):
    points = spark.createDataFrame([(FEB, "a", 7.0), (MAR, "a", None)], "t timestamp_ntz, d string, v double")
    points = points if dims else points.drop("d")
    got = fill_gaps(points, "month", dt.date(2024, 1, 15), dt.date(2024, 3, 20), dims)
    assert rows(got.select("t", "v")) == rows(spark.createDataFrame([(JAN, 0.0), (FEB, 7.0), (MAR, None)], "t timestamp_ntz, v double"))


def test_rolling_over_nulls(spark):
    df = spark.createDataFrame([("a", at(0), None), ("a", at(5), 3), ("a", at(30), None)], "k string, ts timestamp_ntz, v long")
    got = rolling(df, ["k"], "ts", dt.timedelta(minutes=10), {"s": F.col("v")})
    assert [r["s"] for r in got.orderBy("t").collect()] == [None, 3, None]


def test_json_of_another_kind(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('{"k": "x"}',), ("broken",), (None,)], "props string")
    assert [r["k"] for r in json_dim(df, "props", "$.k", "int").collect()] == [1, None, None, None]


def test_null_keys_are_no_orphans(spark):
    fact = spark.createDataFrame([(1,), (2,), (None,), (None,)], "k int")
    assert tuple(orphans(fact, spark.createDataFrame([(1,)], "k int"), "k").first()) == (1, 1)


def test_panel_limit_and_derived_filter(spark, sf):
    base = {"source": "events", "measures": {"n": F.count(F.lit(1))}, "dims": ("event_type",), "order": ("event_type",)}
    assert run_panel(spark, sf, Panel(**base, limit=0)).count() == 0
    panel = Panel(**base, derived={"late": F.hour("ts") >= 12}, filters=(Filter("late", "eq", True), Filter("event_type", "eq", "click")))
    want = spark.read.parquet(f"{sf}/events.parquet").where("hour(ts) >= 12 and event_type = 'click'").count()
    assert [tuple(r) for r in run_panel(spark, sf, panel).collect()] == [("click", want)]


def test_two_streams_into_one_rollup(spark, tmp_path):
    table = str(tmp_path / "rollup")
    events = []
    for i in (1, 2):
        folder = Folder(spark, tmp_path / f"in{i}")
        events.append(_event(i, at(i), i))
        folder.add(events[-1])
        stream_rollup(folder.stream(), table, str(tmp_path / f"c{i}"), _rollup).awaitTermination()
    assert _merged(spark.read.parquet(table)) == _merged(_rollup(spark.createDataFrame(events, SCHEMA)))
