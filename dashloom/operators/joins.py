"""Star enrichment, segments, as-of, interval match, orphans."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grain import time_bucket
from .ordered import BUCKET, KEY, bucketed, carried, in_bucket

Key = str | tuple[str, str]


def _pairs(keys: Key | Sequence[Key]) -> list[tuple[str, str]]:
    keys = [keys] if isinstance(keys, (str, tuple)) else list(keys)
    return [(k, k) if isinstance(k, str) else k for k in keys]


def star(fact: DataFrame, *dims: tuple[DataFrame, Key], how: str = "inner") -> DataFrame:
    """Join a fact to dimensions: `star(lineitem, (orders, ("l_orderkey", "o_orderkey")))`.

    The dimension's key takes the name it has in the fact. No hints: Spark broadcasts a dimension when its size allows and otherwise
    shuffles, with adaptive splitting of skewed keys.
    """
    for dim, key in dims:
        for left, right in _pairs(key):
            if left != right:
                dim = dim.withColumnRenamed(right, left)
        fact = fact.join(dim, [left for left, _ in _pairs(key)], how)
    return fact


def _segment(df: DataFrame, seg: DataFrame, key: Key, how: str) -> DataFrame:
    left, right = zip(*_pairs(key))
    keys = seg.select(*[F.col(r).alias(n) for n, r in zip(left, right)])
    return df.join(keys, list(left), how)


def in_segment(df: DataFrame, seg: DataFrame, key: Key) -> DataFrame:
    """Rows whose key is in the segment."""
    return _segment(df, seg, key, "left_semi")


def not_in_segment(df: DataFrame, seg: DataFrame, key: Key) -> DataFrame:
    """Rows whose key is not in the segment; rows with a null key are kept."""
    return _segment(df, seg, key, "left_anti")


def orphans(fact: DataFrame, dim: DataFrame, key: Key) -> DataFrame:
    """How many fact rows and distinct keys have no dimension row; a null key is no key.

    The fact is counted per key before the join, so a hot key is one row there.
    """
    (left, right), = _pairs(key)
    per_key = fact.where(F.col(left).isNotNull()).groupBy(left).agg(F.count(F.lit(1)).alias("_rows"))
    lost = per_key.join(dim.select(F.col(right).alias(left)), left, "left_anti")
    return lost.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows"),
                    F.count(F.lit(1)).alias("orphan_keys"))


def asof_latest(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str,
                tie: str, values: Sequence[str], strict: bool = False,
                parts: int | None = None, bucket: timedelta = timedelta(hours=1)) -> DataFrame:
    """Each left row with the `values` of the latest right row of its key.

    Latest means the greatest `rt` not after `lt` (before `lt` if strict), then
    the greatest `tie`. Left rows without one keep nulls. Both sides of a key are put in
    one order within each span of `bucket` (a second or more), and the last right row is carried from span to
    span. `parts` is the number of partitions.
    """
    width = max(1, bucket // timedelta(seconds=1))
    # At equal times the right row comes first when it counts as a match.
    side_left, side_right = (0, 1) if strict else (1, 0)
    lefts = left.select(
        F.col(key).alias("_by"), F.col(lt).alias("_t"), time_bucket(left, lt, width).alias("_span"), F.lit(side_left).alias("_side"),
        F.struct(*left.columns).alias("_left"))
    rights = right.filter(F.col(key).isNotNull() & F.col(rt).isNotNull()).select(
        F.col(key).alias("_by"), F.col(rt).alias("_t"), time_bucket(right, rt, width).alias("_span"), F.lit(side_right).alias("_side"),
        F.col(tie).alias("_tie"), F.struct(*values).alias("_right"))
    is_right = F.col("_side") == side_right
    order = [F.col("_t"), F.col("_side"), F.col("_tie")]
    both = bucketed(lefts.unionByName(rights, allowMissingColumns=True), ["_by"], F.col("_span"), parts)
    latest = F.max_by("_right", F.when(is_right, F.struct("_t", "_tie")))
    carry = carried(both, {"_before": (latest, lambda c: F.last(c, ignorenulls=True))})
    here = F.last("_right", ignorenulls=True).over(in_bucket(order))
    seen = both.withColumn("_here", here).filter(~is_right)
    found = seen.join(carry, [KEY, BUCKET], "left").select(
        "_left", F.coalesce("_here", "_before").alias("_hit"))
    return found.select("_left.*", *[F.col(f"_hit.{v}").alias(v) for v in values])


def within(a: DataFrame, b: DataFrame, key: str, a_time: str, b_time: str,
           delta: timedelta) -> DataFrame:
    """Pairs of the same key where b is 0 to `delta` after a.

    Both sides get a time bucket a little wider than `delta`; a row of `a` can only
    match its own bucket and the next. The join is on key and bucket, so the rows
    compared are neighbours in time and a busy key is spread over its buckets.
    """
    width = delta // timedelta(seconds=1) + 1
    first = time_bucket(a, a_time, width)
    left = a.withColumn("_bucket", F.explode(F.array(first, first + 1)))
    right = b.withColumn("_bucket", time_bucket(b, b_time, width))
    start, end = F.col(a_time), F.col(a_time) + F.lit(delta)
    return (left.join(right, [key, "_bucket"])
            .filter((F.col(b_time) >= start) & (F.col(b_time) <= end)).drop("_bucket"))
