"""Ordered operators where a few keys hold most rows, against plain Python."""

import datetime as dt
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from conftest import at, plan, rows
from dashloom.operators.aggregates import percentiles
from dashloom.operators.behaviour import funnel_times
from dashloom.operators.joins import asof_latest
from dashloom.operators.ordered import CHUNK, split_in_order
from dashloom.operators.ranking import pareto, top_per_group
from dashloom.operators.series import rolling

# One chunk, a few, more than some have rows.
PARTS = [1, 7, 40]


def _users(rng, n):
    """Every second row belongs to user 1, and one in ten has no user."""
    return [1 if rng.random() < 0.5 else rng.choice([2, 3, 4, 5, 6, 7, None]) for _ in range(n)]


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, parts, strict):
    rng = random.Random(3)
    left = [(i, u, at(rng.randrange(120))) for i, u in enumerate(_users(rng, 300))]
    left += [(900, 1, at(50)), (901, 1, at(50))] * 40  # copies
    right = [(i, u, at(rng.randrange(120)), i * 10) for i, u in enumerate(_users(rng, 200))]
    want = []
    for i, u, t in left:
        ok = [(rt, tie, v) for tie, ru, rt, v in right
              if u is not None and ru == u and (rt < t if strict else rt <= t)]
        want.append((i, u, t, max(ok)[2] if ok else None))
    ldf = spark.createDataFrame(left, "id long, user_id long, ts timestamp_ntz").repartition(3)
    rdf = spark.createDataFrame(
        right, "rid long, user_id long, rts timestamp_ntz, v long").repartition(3)
    got = asof_latest(ldf, rdf, "user_id", "ts", "rts", "rid", ["v"], strict, parts=parts)
    assert sorted(map(str, got.collect())) == sorted(
        map(str, spark.createDataFrame(want, got.schema).collect()))


@pytest.mark.parametrize("parts", PARTS)
def test_rolling(spark, parts):
    rng = random.Random(4)
    data = [(u, at(rng.randrange(300)), rng.randrange(1, 1000)) for u in _users(rng, 400)]
    df = spark.createDataFrame(data, "u long, ts timestamp_ntz, v long").repartition(3)
    got = rolling(df, ["u"], "ts", dt.timedelta(minutes=30),
                  {"s": F.col("v"), "n": F.lit(1)}, parts=parts)
    want = set()
    for u, t, _ in data:
        vs = [v for uu, tt, v in data if uu == u and t - dt.timedelta(minutes=30) <= tt <= t]
        want.add((u, t, sum(vs), len(vs)))
    assert len(want) == got.count()
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("parts", PARTS)
def test_percentiles(spark, parts):
    rng = random.Random(5)
    data = [(rng.choice(["a", "a", "a", "b", None]), float(rng.randrange(60))) for _ in range(500)]
    data += [("one", 7.0), ("two", 1.0), ("two", 2.0), ("gone", None)]
    df = spark.createDataFrame(data, "d string, v double").repartition(3)
    ps = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r[0]: tuple(r)[1:] for r in percentiles(df, ["d"], "v", ps, parts=parts).collect()}
    groups = defaultdict(list)
    for d, v in data:
        if v is not None:
            groups[d].append(v)
    assert set(got) == {*groups, "gone"}
    assert got["gone"] == (None,) * len(ps)
    for d, vs in groups.items():
        vs.sort()
        for p, found in zip(ps, got[d]):
            pos = Fraction(str(p)) * (len(vs) - 1)
            lo = int(pos)
            hi = min(lo + (pos > lo), len(vs) - 1)
            assert found == pytest.approx(float(vs[lo] + (vs[hi] - vs[lo]) * (pos - lo)))


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("top", [3, 1000])
def test_pareto(spark, parts, top):
    """Few distinct values make runs of equal values that go over several chunks."""
    rng = random.Random(6)
    values = {i: rng.randrange(1, top + 1) for i in range(203)}
    df = spark.createDataFrame(list(values.items()), "k long, v long").repartition(3)
    got = {r.k: r for r in pareto(df, "k", F.sum("v"), 4, parts=parts).collect()}
    ranked = sorted(values, key=lambda k: (-values[k], k))
    total, running = sum(values.values()), 0
    sizes = [51, 51, 51, 50]
    tiles = [t + 1 for t, s in enumerate(sizes) for _ in range(s)]
    for place, k in enumerate(ranked):
        running += values[k]
        assert got[k].cum_share == running / total
        assert got[k].share == values[k] / total
        assert got[k].tile == tiles[place]
        above = sum(v > values[k] for v in values.values())
        assert got[k].pct_rank == above / 202


def test_pareto_small(spark):
    one = spark.createDataFrame([("a", 5)], "k string, v long")
    assert rows(pareto(one, "k", F.sum("v"))) == [("a", 5.0, 1.0, 1.0, 1, 0.0)]
    three = spark.createDataFrame([(k, 1) for k in "abc"], "k string, v long")
    assert [r[4] for r in rows(pareto(three, "k", F.sum("v")))] == [1, 2, 3]
    assert rows(pareto(one.limit(0), "k", F.sum("v"))) == []


def test_funnel(spark):
    rng = random.Random(7)
    users = _users(rng, 500)
    data = [(u, at(rng.randrange(400)), rng.choice("abcx")) for u in users]
    df = spark.createDataFrame(data, "u long, ts timestamp_ntz, kind string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in
           funnel_times(df, "u", "ts", "kind", ["a", "b", "c"]).collect()}
    want = {}
    for u in {u for u in users if u is not None}:
        times, after = [], None
        for step in "abc":
            ok = [t for uu, t, k in data
                  if uu == u and k == step and (not times or after is not None and t > after)]
            after = min(ok, default=None) if not times or after is not None else None
            times.append(after)
        if times[0] is not None:
            want[u] = tuple(times)
    assert got == want


@pytest.mark.parametrize("parts", [1, 5])
def test_null_sums(spark, parts):
    """A span that holds nulls only has no total, in one chunk as in several."""
    data = [(1, at(m), None if m < 40 else m) for m in range(60)]
    df = spark.createDataFrame(data, "u long, ts timestamp_ntz, v long")
    got = rolling(df, ["u"], "ts", dt.timedelta(minutes=5), {"s": F.col("v")}, parts=parts)
    want = [(1, at(m), sum(range(max(40, m - 5), m + 1)) if m >= 40 else None) for m in range(60)]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want


def test_chunks_are_even(spark):
    """One key with a third of the rows, all at one moment, is cut as well."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.lit(at(0)).cast("timestamp_ntz").alias("t"), F.col("id").alias("v")).repartition(20)
    chunks = split_in_order(df, ["k"], [F.col("t")], 8)
    sizes = [r["count"] for r in chunks.groupBy(CHUNK).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 6000 / 4


def test_top_of_large_groups(spark):
    """More than Spark cuts by itself: the group is cut in parts before it meets in one task."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("d"))
    got = top_per_group(df, ["g"], "d", F.max(F.col("d") % 7000), 5000, salts=4)
    want = sorted(((d % 2, -(d % 7000), d) for d in range(20_000)))
    want = [x for g in (0, 1) for x in [w for w in want if w[0] == g][:5000]]
    assert sorted((r.g, -r.value, r.d) for r in got.collect()) == want
    assert "_salt" in plan(got)


def test_carry_is_small(spark):
    """What is broadcast grows with the chunks and not with the keys."""
    from dashloom.operators.ordered import carry_over
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    chunks = split_in_order(df, ["k"], [F.col("v")], 9)
    carry = carry_over(chunks, {"s": (F.sum("v"), F.sum)})
    assert carry.count() <= 2 * chunks.select(CHUNK).distinct().count()
    assert "SinglePartition" not in plan(chunks)


def test_skewed_joins_are_split(spark):
    """Joins without a broadcast: adaptive execution splits the hot key's partition."""
    from dashloom.operators.joins import in_segment, star
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100000",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200000",
            "spark.sql.shuffle.partitions": "20"}
    spark = spark.newSession()  # settings of its own
    for k, v in conf.items():
        spark.conf.set(k, v)
    fact = spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.xxhash64("id").alias("v"))
    dim = spark.range(300_000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("d"))
    joined = star(fact, (dim, ("k", "key"))).groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), F.max("v"))
    assert sum(r.n for r in joined.collect()) == 300_000
    assert "skew=true" in plan(joined)
    inside = in_segment(fact, dim.filter("d = 0"), ("k", "key"))
    assert len(inside.collect()) == fact.filter("k % 7 = 0").count()
    assert "skew=true" in plan(inside)
