"""Time series.

Panels first aggregate the fact to one row per grain and dimension. The windows
here run over such series, whose length is the number of grains in the time
range and does not grow with the fact. Where the rows of a key are not aggregated
to a grain (`rolling`), spans of time are used instead of a window over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grain import STEPS, time_bucket, truncate
from .ordered import BUCKET, KEY, bucketed, carried, in_bucket


def series(df: DataFrame, time: str, grain: str, measures: Mapping[str, Column],
           dims: Sequence[str] = ()) -> DataFrame:
    """Measures per grain, the grain start in column `t`."""
    return df.groupBy(truncate(time, grain).alias("t"), *dims).agg(
        *[c.alias(n) for n, c in measures.items()])


def fill_gaps(points: DataFrame, grain: str, lo: date | datetime, hi: date | datetime,
              dims: Sequence[str] = (), default: float = 0) -> DataFrame:
    """One row for every grain from lo to hi (both included), per dimension value.

    lo and hi may lie anywhere in their grain. Only rows that had no point get `default`;
    a measure that is null stays null.
    Expects one row per grain and dimension value. Each row also stands for the
    missing grains up to the next one, so nothing has to be joined.
    """
    lo, hi = [x if isinstance(x, datetime) else datetime(x.year, x.month, x.day)
              for x in (lo, hi)]
    values = [c for c in points.columns if c not in ("t", *dims)]
    lo, hi = [truncate(F.lit(x.isoformat()).cast("timestamp_ntz"), grain) for x in (lo, hi)]
    if not dims:
        every = points.sparkSession.range(1).select(F.explode(F.sequence(lo, hi, F.expr(STEPS[grain]))).alias("t"))
        found = every.join(points.withColumn("_had", F.lit(True)), "t", "left")
        return found.select("t", *[F.when(F.col("_had"), F.col(v)).otherwise(F.lit(default)).alias(v) for v in values])
    step, at = F.expr(STEPS[grain]), F.col("t")
    w = W.partitionBy(*dims).orderBy("t")
    first = F.when(F.row_number().over(w) == 1, lo).otherwise(F.greatest(at, lo))
    last = F.least(F.lead("t").over(w) - step, hi)  # of null and hi it is hi
    spans = points.withColumns({"_first": first, "_last": last})
    grains = F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last", step))
    every = spans.select("*", F.explode(grains).alias("_t"))
    kept = [F.when(F.col("_t") == at, F.col(v)).otherwise(F.lit(default)).alias(v) for v in values]
    return every.select(F.col("_t").alias("t"), *dims, *kept)


def _ordered(dims: Sequence[str]) -> WindowSpec:
    return (W.partitionBy(*dims) if dims else W.partitionBy()).orderBy("t")


def vs_previous(points: DataFrame, measure: str, lag: int = 1,
                dims: Sequence[str] = ()) -> DataFrame:
    """The value `lag` grains earlier, the change and the change in percent.

    Expects a series without gaps.
    """
    before = F.lag(measure, lag).over(_ordered(dims))
    change = F.col(measure) - F.col("previous")
    return (points.withColumn("previous", before).withColumn("change", change)
            .withColumn("change_pct", F.try_divide(F.col("change") * 100.0, F.col("previous"))))


def moving(points: DataFrame, measure: str, n: int, dims: Sequence[str] = ()) -> DataFrame:
    """Average over the current and the n-1 grains before it."""
    w = _ordered(dims).rowsBetween(1 - n, 0)
    return points.withColumn("moving_avg", F.avg(measure).over(w))


def running(points: DataFrame, measure: str, dims: Sequence[str] = ()) -> DataFrame:
    """Total since the start of the series."""
    w = _ordered(dims).rowsBetween(W.unboundedPreceding, 0)
    return points.withColumn("running_total", F.sum(measure).over(w))


def rolling(df: DataFrame, by: Sequence[str], time: str, back: timedelta,
            values: Mapping[str, Column], parts: int | None = None,
            bucket: timedelta = timedelta(hours=1)) -> DataFrame:
    """Totals over the span `back` up to each moment a key has a row.

    One row per key and moment; a row exactly `back` earlier still counts. Each
    moment enters the running sum with its values and leaves it, as a negative
    entry, once it is older than `back`; the running sum is then the total. Values
    should be integers, such as cents, or decimals, for which that is exact. A span
    that holds nulls only has no total: as many entries as leavings are known.
    A key is dealt by spans of `bucket` (a second or more); `parts` is the number of partitions.
    """
    known = {n: f"_known_{n}" for n in values}
    span = F.lit(back)
    moments = df.groupBy(*by, F.col(time).alias("t")).agg(
        *[F.sum(c).alias(n) for n, c in values.items()])
    # At the same moment entries come before leavings.
    moments = moments.withColumns({k: F.col(n).isNotNull().cast("bigint") for n, k in known.items()})
    enter = moments.withColumn("_leaving", F.lit(0))
    leave = moments.select(
        *by, (F.col("t") + span).alias("t"),
        *[(-F.col(n)).alias(n) for n in (*values, *known.values())], F.lit(1).alias("_leaving"))
    order = [F.col("t"), F.col("_leaving")]
    both = enter.unionByName(leave)
    width = max(1, bucket // timedelta(seconds=1))
    rows, names = bucketed(both, by, time_bucket(both, "t", width), parts), [*values, *known.values()]
    carry = carried(rows, {f"_b_{n}": (F.sum(n), F.sum) for n in names})
    here = rows.select("*", *[F.sum(n).over(in_bucket(order)).alias(f"_h_{n}") for n in names])
    sums = here.filter(F.col("_leaving") == 0).join(carry, [KEY, BUCKET], "left")

    def so_far(n: str) -> Column:
        before, now = F.col(f"_b_{n}"), F.col(f"_h_{n}")
        return F.coalesce(before + now, before, now)

    return sums.select(*by, "t", *[F.when(so_far(k) > 0, so_far(n)).alias(n) for n, k in known.items()])


def zscore(points: DataFrame, measure: str, n: int, dims: Sequence[str] = ()) -> DataFrame:
    """Deviation from the mean of the n grains before, in their standard deviations.

    Null while fewer than two grains came before or where they do not vary.
    """
    w = _ordered(dims).rowsBetween(-n, -1)
    return (points.withColumn("trail_avg", F.avg(measure).over(w))
            .withColumn("trail_std", F.stddev_samp(measure).over(w))
            .withColumn("zscore", F.try_divide(F.col(measure) - F.col("trail_avg"),
                                               F.col("trail_std"))))
