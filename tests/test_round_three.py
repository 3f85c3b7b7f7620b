"""Funnels in one pass, copies of one row, time zones, late rows of long streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import at, plan, rows
from dashloom.functions.grain import as_instant, as_local
from dashloom.operators import sets
from dashloom.operators.aggregates import breakdown, distinct_bitmaps, merge_bitmaps
from dashloom.operators.behaviour import funnel, funnel_times
from dashloom.operators.filters import json_dims
from dashloom.operators.series import series
from dashloom.streaming import live as L
from dashloom.sources.rollups import read_rollup
from dashloom.streaming.rollup import stream_rollup
from test_streams import Folder, _event, _merged, _rollup

SCHEMA = "user long, t timestamp_ntz, kind string"


def by_hand(events, steps):
    out = {}
    for user in {e[0] for e in events}:
        times, last = [], None
        for s in steps:
            later = [t for u, t, k in events if u == user and k == s and t is not None and (last is None or t > last)]
            if not later:
                break
            last = min(later)
            times.append(last)
        if times and user is not None:
            out[user] = tuple(times + [None] * (len(steps) - len(times)))
    return out


@pytest.mark.parametrize("steps", [["a"], ["a", "b", "c"], ["a", "a", "b"], ["c", "b", "a", "c"]])
@pytest.mark.parametrize("bucket", [1, 7, 10_000])
def test_funnel_by_hand(spark, steps, bucket):
    r = random.Random(len(steps) * bucket)
    events = [(r.choice([1, 2, 3, 4, None]), r.choice([None, *[at(r.randrange(40)) for _ in range(9)]]), r.choice("abcd")) for _ in range(160)]
    events += [(9, at(5), k) for k in "abc"]  # ties: a step needs a later time
    got = funnel_times(spark.createDataFrame(events, SCHEMA), "user", "t", "kind", steps, dt.timedelta(minutes=bucket))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == by_hand(events, steps)


def test_funnel_reads_once(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    text = plan(funnel(events, "user_id", "ts", "event_type", ["view", "click", "purchase", "view"]))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_busy_user(spark):
    busy = spark.range(50_000).select(F.lit(1).alias("user"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("t"),
                                      F.when(F.col("id") == 40_000, "b").when(F.col("id") == 49_999, "c").otherwise("a").alias("kind"))
    row, = funnel_times(busy, "user", "t", "kind", ["a", "b", "c"]).collect()
    start = dt.datetime(2024, 1, 1)
    assert tuple(row)[1:] == (start, start + dt.timedelta(seconds=40_000), start + dt.timedelta(seconds=49_999))


def test_copies_left_over(spark, monkeypatch):
    monkeypatch.setattr(sets, "COPIES", 10)
    a = spark.createDataFrame([(1, "x")] * 37 + [(2, None)] * 3 + [(3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x")] * 4 + [(2, None)] * 3 + [(4, "q")], "k long, v string")
    found = sets.members(a, b, "only_first_all")
    assert rows(found) == rows(a.exceptAll(b)) and found.count() == 34
    assert sets.members(a.limit(0), b, "only_first_all").count() == 0


@pytest.fixture(params=["America/New_York", "Asia/Kolkata"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_times_in_any_zone(spark, zone, tmp_path):
    """02:30 on 10 March 2024 does not exist in New York; it is an hour of the data like others."""
    times = [dt.datetime(2024, 3, 10, h, 30, 5, 123456) for h in range(5)] + [dt.datetime(2024, 11, 3, h, 30) for h in range(4)] + [dt.datetime(1969, 12, 31, 23, 59, 59, 1)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert rows(df.select(as_local(as_instant(F.col("t"))))) == rows(df)
    folder = Folder(spark, tmp_path / "events")
    folder.add(*[_event(i, t) for i, t in enumerate(times)])
    got = L.drain(L.live_series(folder.stream(), "ts", "1 hour", "1 hour", {"n": F.count(F.lit(1))}), "complete")
    batch = series(spark.read.parquet(folder.path), "ts", "hour", {"n": F.count(F.lit(1))})
    assert rows(got.select("window_start", "n")) == rows(batch.select("t", "n"))


def test_rollup_days_in_any_zone(spark, zone, tmp_path):
    folder = Folder(spark, tmp_path / "events")
    folder.add(*[_event(i, dt.datetime(2024, 3, 9 + i // 8, i % 8 * 3, 30)) for i in range(24)])
    stream_rollup(folder.stream(), str(tmp_path / "t"), str(tmp_path / "c"), _rollup).awaitTermination()
    assert _merged(read_rollup(spark, str(tmp_path / "t"))) == _merged(_rollup(spark.read.parquet(folder.path)))


def test_late_rows_of_many_batches(spark, tmp_path):
    """More batches than a query remembers: the query's own records lose some, the listener none."""
    folder, old = Folder(spark, tmp_path / "events"), spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for i, minute in enumerate([0, 6000, 6001, *[1] * 5]):
            folder.add(_event(i, at(minute)))
        with L.LateRows(spark) as late:
            seen = L.live_dedup(folder.stream(), "ts", ["event_id"], "1 hour", salts=1)
            run = (seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
            run.awaitTermination()
            assert late.total(run) == 5 > L.late_dropped(run)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)


def test_bitmaps_are_exact(spark):
    values = [0, 1, 1, 32_768, 32_769, -1, -40_000, 2**40, None, 7]
    df = spark.createDataFrame([(i % 3, "a" if i % 2 else None, v) for i, v in enumerate(values * 3)], "day int, g string, v long")
    merged = merge_bitmaps(distinct_bitmaps(df, ["day", "g"], "v"), ["g"])
    want = df.filter("v is not null").groupBy("g").agg(F.count_distinct("v"))
    assert rows(merged) == rows(want)
    assert merge_bitmaps(distinct_bitmaps(df.limit(0), ["g"], "v"), ["g"]).count() == 0
    assert rows(merge_bitmaps(distinct_bitmaps(df, [], "v"), [])) == [(8,)]


def test_json_is_parsed_once(spark):
    texts = [(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": "no number", "b": {}}'), (3, "not json"), (4, None), (5, "{}")]
    df = spark.createDataFrame(texts, "i int, js string")
    found = json_dims(df, "js", {"a": ("$.a", "bigint"), "c": ("$.b.c", "string"), "a_text": ("$.a", "string")})
    assert found.columns == ["i", "js", "a", "c", "a_text"]
    assert rows(found.drop("js")) == [(1, 1, "x", "1"), (2, None, None, "no number"), (3, None, None, None), (4, None, None, None), (5, None, None, None)]
    assert plan(breakdown(found, ["a", "c", "a_text"], {"n": F.count(F.lit(1))})).count("parseJson") == 1
