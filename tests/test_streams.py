"""Streams and rollup tables: late rows, copies, split days, replays."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import at, plan, rows
from dashloom.functions.measures import cents
from dashloom.session import clear, freeze, new_path, own_dir, shared_dir
from dashloom.sources.rollups import (compact_rollup, daily_rollup, merge_rollup, read_rollup,
                                      write_rollup)
from dashloom.sources.tables import event_stream
from dashloom.streaming import live as L
from dashloom.streaming.rollup import stream_rollup

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _event(i, t, user=1, kind="click", value=1.0):
    return (i, t, user, kind, value)


class Folder:
    """A folder that gets one file of events after the other."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)
        path.mkdir()

    def add(self, *events):
        (self.spark.createDataFrame(events, SCHEMA).coalesce(1)
         .write.mode("append").parquet(self.path))

    def stream(self):
        return event_stream(self.spark, self.path, "*.parquet", schema=SCHEMA, max_files=1)


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, tmp_path / "events")


def _run(df, out, mode="append"):
    """One run over what is there now, as a restarted query would do."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/out")
         .option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def test_shared_folder(spark, tmp_path):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x") != new_path(spark, "x")
    assert new_path(spark, "x").startswith(own_dir(spark) + "/")
    freeze(spark.range(3), "gone")
    assert any(name.startswith("gone") for name in os.listdir(own_dir(spark)))
    clear(spark)
    assert not os.path.exists(own_dir(spark)) and os.path.exists(shared_dir(spark))


def test_late_rows_are_dropped(spark, folder, tmp_path):
    out = str(tmp_path / "q")
    series = L.live_series(folder.stream(), "ts", "1 hour", "1 hour",
                           {"n": F.count(F.lit(1))})
    folder.add(_event(1, at(0)), _event(2, at(10)))
    _run(series, out)
    folder.add(_event(3, at(0, 5)))
    _run(series, out)
    folder.add(_event(4, at(10, 5)))  # the threshold follows one batch later
    _run(series, out)
    folder.add(_event(5, at(20)))     # four days late
    q = _run(series, out)
    assert L.late_dropped(q) > 0
    got = spark.read.parquet(f"{out}/out")
    assert rows(got.select("window_start", "n")) == [(at(0), 2)]


def test_table_of_part_files(spark, sf, tmp_path):
    """A table written by Spark is a folder; another table lies beside it."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    events.limit(5).write.parquet(f"{tmp_path}/orders.parquet")
    for path in (sf, str(tmp_path)):
        assert L.drain(event_stream(spark, path)).count() == events.count()


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_empty_stream(folder, mode):
    series = L.live_series(folder.stream(), "ts", "1 hour", "1 hour", {"n": F.count(F.lit(1))})
    assert L.drain(series, mode).collect() == []


def test_complete_equals_batch(spark, folder):
    folder.add(*[_event(i, at(i * 7 % 300), i % 5) for i in range(60)])
    folder.add(*[_event(i, at(i * 11 % 300), i % 5) for i in range(60, 100)])
    got = L.drain(L.live_series(folder.stream(), "ts", "1 hour", "1 hour",
                                {"n": F.count(F.lit(1))}), "complete")
    batch = spark.read.schema(SCHEMA).parquet(folder.path)
    want = batch.groupBy(F.window("ts", "1 hour").alias("w")).count()
    assert rows(got.select("window_start", "n")) == rows(want.select("w.start", "count"))


@pytest.mark.parametrize("salts", [1, 3])
def test_copies_over_files(spark, folder, salts):
    folder.add(*[_event(1, at(0))] * 5, _event(2, at(1)))
    folder.add(*[_event(1, at(0))] * 3, _event(3, at(2)))
    got = L.drain(L.live_dedup(folder.stream(), "ts", ["event_id"], "1 hour", salts))
    assert rows(got.select("event_id")) == [(1,), (2,), (3,)]


@pytest.mark.parametrize("salts", [1, 3])
def test_pairs_of_streams(spark, folder, salts):
    folder.add(_event(1, at(0), 1, "a"), _event(2, at(60), 1, "b"), _event(3, at(61), 1, "b"))
    folder.add(_event(4, at(30), 1, "b"), _event(5, at(30), 2, "b"))

    def side(kind):
        return folder.stream().filter(F.col("event_type") == kind).select(
            F.col("event_id").alias(kind), "user_id", F.col("ts").alias(f"t_{kind}"))
    got = L.drain(L.live_within(side("a"), side("b"), "user_id", "t_a", "t_b", "1 hour",
                                "1 hour", salts))
    assert rows(got.select("a", "b")) == [(1, 2), (1, 4)]


@pytest.mark.parametrize("salts", [1, 3])
def test_enriched(spark, folder, salts):
    folder.add(*[_event(i, at(i), 1) for i in range(9)], _event(9, at(9), 2), _event(10, at(9), 3))
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "key long, name string")
    for how, extra in (("inner", []), ("left", [(None, 1)])):
        got = L.drain(L.live_enrich(folder.stream(), dim, ("user_id", "key"), how, salts))
        assert rows(got.groupBy("name").count()) == [*extra, ("one", 9), ("two", 1)]


def test_sessions_over_files(spark, folder):
    folder.add(_event(1, at(0)), _event(2, at(20)))
    folder.add(_event(3, at(40)), _event(4, at(0, 2)))
    folder.add(_event(5, at(0, 3)))
    got = L.drain(L.live_sessions(folder.stream(), "user_id", "ts", "30 minutes", "1 hour",
                                  {"n": F.count(F.lit(1))}))
    assert rows(got.select("session_start", "session_end", "n")) == [
        (at(0), at(70), 3), (at(0, 2), at(30, 2), 1)]


def _rollup(df):
    return daily_rollup(df, "ts", ["event_type"], {"value": cents("value")}, "user_id")


def _merged(df):
    return rows(merge_rollup(df, ["day", "event_type"], ["value"]).select(
        "day", "event_type", "n", "value", F.hll_sketch_estimate("users")))


def test_split_day_and_replay(spark, folder, tmp_path):
    """A day over two batches, then both batches once more from an older checkpoint."""
    folder.add(_event(1, at(0), 1), _event(2, at(5), 2), _event(3, at(0, 2), 1))
    folder.add(_event(4, at(9), 2), _event(5, at(10), 3))
    table = str(tmp_path / "rollup")
    stream_rollup(folder.stream(), table, str(tmp_path / "c1"), _rollup, name="events").awaitTermination()
    want = _merged(_rollup(spark.read.schema(SCHEMA).parquet(folder.path)))
    assert _merged(spark.read.parquet(table)) == want
    assert spark.read.parquet(table).select("batch_id").distinct().count() == 2
    stream_rollup(folder.stream(), table, str(tmp_path / "c2"), _rollup, name="events").awaitTermination()
    assert _merged(spark.read.parquet(table)) == want
    compact_rollup(spark, table, str(tmp_path / "compact"), ["event_type"], ["value"])
    compact = spark.read.parquet(str(tmp_path / "compact"))
    assert compact.count() == 2 and _merged(compact) == want


def test_rewriting_a_day_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "rollup")
    events = spark.createDataFrame(
        [_event(i, at(i, day), i) for day in (1, 2, 3) for i in range(4)], SCHEMA)
    write_rollup(_rollup(events), path)
    write_rollup(_rollup(events.filter("ts >= '2024-01-02' and ts < '2024-01-03'").limit(1)), path)
    assert [(r[0].day, r[2]) for r in _merged(read_rollup(spark, path))] == [(1, 4), (2, 1), (3, 4)]
    some = read_rollup(spark, path, dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    assert some.count() == 1
    assert "PartitionFilters: [isnotnull(day" in plan(some)


def test_rollup_answers_as_the_fact(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = str(tmp_path / "rollup")
    write_rollup(_rollup(events), path)
    found = merge_rollup(read_rollup(spark, path), [], ["value"]).select(
        "n", "value", F.hll_sketch_estimate("users")).collect()[0]
    exact = events.agg(F.count(F.lit(1)), F.sum(cents("value")),
                       F.count_distinct("user_id")).collect()[0]
    assert found[:2] == exact[:2]
    assert abs(found[2] - exact[2]) <= 0.05 * exact[2]
