"""Rollups in parts: new checkpoints, replays, crashes, merging."""

import shutil

import pytest
from pyspark.sql import functions as F

import dashloom.streaming.rollup as streamed
from conftest import at, rows
from dashloom.functions.measures import cents
from dashloom.sources import rollups as R
from test_streams import Folder, _event, _merged, _rollup


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, tmp_path / "events")


def run(folder, table, checkpoint, **more):
    streamed.stream_rollup(folder.stream(), str(table), str(checkpoint), _rollup, **more).awaitTermination()


def count(spark, table):
    return R.read_rollup(spark, str(table)).agg(F.sum("n")).first()[0]


def test_new_checkpoint_in_the_same_folder(spark, tmp_path):
    table, checkpoint = tmp_path / "t", tmp_path / "c"
    for i in range(2):
        folder = Folder(spark, tmp_path / f"events{i}")
        folder.add(_event(i, at(i)))
        run(folder, table, checkpoint)
        shutil.rmtree(checkpoint)
    assert count(spark, table) == 2


def test_restart_adds_once(spark, folder, tmp_path):
    folder.add(_event(1, at(0)))
    run(folder, tmp_path / "t", tmp_path / "c")
    run(folder, tmp_path / "t", tmp_path / "c")
    folder.add(_event(2, at(5)))
    run(folder, tmp_path / "t", tmp_path / "c")
    assert count(spark, tmp_path / "t") == 2 and len(R.standing(spark, str(tmp_path / "t"))) == 2


def test_crash_before_the_ledger(spark, folder, tmp_path, monkeypatch):
    """Files without an entry do not count; the batch that is run again puts them right."""
    folder.add(_event(1, at(0)))
    run(folder, tmp_path / "t", tmp_path / "c")
    folder.add(_event(2, at(5)))

    def fail(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
        m.setattr(streamed, "commit_part", fail)
        run(folder, tmp_path / "t", tmp_path / "c")
    assert count(spark, tmp_path / "t") == 1
    run(folder, tmp_path / "t", tmp_path / "c")
    assert count(spark, tmp_path / "t") == 2


def test_merging_reads_new_parts_only(spark, folder, tmp_path, monkeypatch):
    table, read, real = str(tmp_path / "t"), [], R._read_parts
    monkeypatch.setattr(R, "_read_parts", lambda s, p, parts: read.append(list(parts)) or real(s, p, parts))
    days = 0
    for turn in range(3):
        for _ in range(3):
            folder.add(_event(days, at(days * 3, 1 + days % 2), days, "a" if days % 3 else "b"))
            days += 1
        run(folder, table, tmp_path / "c")
        read.clear()
        new = R.compact_parts(spark, table, ["event_type"], ["value"], fan_in=3)
        assert len(new) == (2 if turn == 2 else 1) and len(read[0]) == 3
    want = _merged(_rollup(spark.read.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double").parquet(folder.path)))
    assert _merged(R.read_rollup(spark, table)) == want and len(R.standing(spark, table)) == 1
    R.drop_replaced(spark, table)
    assert _merged(R.read_rollup(spark, table)) == want
    assert R.compact_parts(spark, table, ["event_type"], ["value"], fan_in=3) == []


def test_failed_merge_changes_nothing(spark, folder, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    folder.add(_event(1, at(0)))
    folder.add(_event(2, at(5)))
    run(folder, table, tmp_path / "c")
    before = rows(R.read_rollup(spark, table).select("batch_id", "n"))

    def fail(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(R, "commit_part", fail)
        R.compact_parts(spark, table, ["event_type"], ["value"])
    assert rows(R.read_rollup(spark, table).select("batch_id", "n")) == before


def test_replay_of_merged_parts_is_refused(spark, folder, tmp_path):
    table = str(tmp_path / "t")
    folder.add(_event(1, at(0)))
    folder.add(_event(2, at(5)))
    run(folder, table, tmp_path / "c1", name="events")
    run(folder, table, tmp_path / "c2", name="events")
    assert count(spark, table) == 2
    R.compact_parts(spark, table, ["event_type"], ["value"])
    with pytest.raises(Exception, match="has been merged"):
        run(folder, table, tmp_path / "c3", name="events")
    assert count(spark, table) == 2


def test_empty_batches(spark, folder, tmp_path):
    folder.add(_event(1, at(0)))
    folder.add(_event(2, at(5), kind="gone"))
    stream = folder.stream().filter("event_type != 'gone'")
    streamed.stream_rollup(stream, str(tmp_path / "t"), str(tmp_path / "c"), _rollup).awaitTermination()
    assert count(spark, tmp_path / "t") == 1 and cents is not None
