"""Comparing and stacking panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period_diff(a: DataFrame, b: DataFrame, key: str, measure: Column) -> DataFrame:
    """Each key's measure in period a and b, and whether it was added, removed,
    changed or stayed the same. Null keys match each other."""
    before = a.groupBy(F.col(key).alias("_ka")).agg(
        measure.alias("before"), F.lit(True).alias("_a"))
    after = b.groupBy(F.col(key).alias("_kb")).agg(
        measure.alias("after"), F.lit(True).alias("_b"))
    both = before.join(after, F.col("_ka").eqNullSafe(F.col("_kb")), "full_outer")
    status = (F.when(F.col("_a").isNull(), "added")
              .when(F.col("_b").isNull(), "removed")
              .when(F.col("before").eqNullSafe(F.col("after")), "same")
              .otherwise("changed"))
    return both.select(F.coalesce("_ka", "_kb").alias(key), "before", "after",
                       status.alias("status"))


COPIES = 1 << 16  # copies of a row given out by one task at once


def _left_over(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a less as many copies as b has, by counts that are combined before the shuffle."""
    n = F.sum("_n").alias("_n")
    counted = a.withColumn("_n", F.lit(1)).union(b.withColumn("_n", F.lit(-1))).groupBy(*a.columns).agg(n)
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES))
    dealt = counted.filter("_n > 0").withColumn("_part", F.explode(parts)).hint("rebalance")
    copies = F.least(F.lit(COPIES).cast("bigint"), F.col("_n") - F.col("_part") * COPIES)
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(*a.columns)


def members(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Rows in both, in either, only in a, or only in a counting copies.

    op is one of: both, either, only_first, only_first_all. Copies are dropped
    or counted before the two sides meet, and those left over are given out by many tasks, so a
    row with very many copies is no burden. Columns are matched by place.
    """
    if op == "both":
        return a.distinct().intersect(b.distinct())
    if op == "either":
        return a.unionByName(b).distinct()
    if op == "only_first":
        return a.distinct().subtract(b.distinct())
    if op == "only_first_all":
        return _left_over(a, b)
    raise ValueError(f"unknown op {op!r}")


def stack(*dfs: DataFrame) -> DataFrame:
    """Panels under each other, columns matched by name, missing ones null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)
