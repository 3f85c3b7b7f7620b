"""Time grains and time arithmetic that do not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATE_GRAINS = ("year", "quarter", "month", "week")
GRAINS = ("minute", "hour", "day", *_DATE_GRAINS)

STEPS = {
    "minute": "INTERVAL 1 MINUTE",
    "hour": "INTERVAL 1 HOUR",
    "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAY",
    "month": "INTERVAL 1 MONTH",
    "quarter": "INTERVAL 3 MONTH",
    "year": "INTERVAL 1 YEAR",
}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_SECONDS = {"minute": 60, "hour": 3600, "day": 86_400, "week": 7 * 86_400}


def calendar(spark: SparkSession, grain: str, lo: datetime, hi: datetime) -> DataFrame:
    """Every grain start from lo to hi, in column `t`, made in parallel."""
    start, end = [F.lit(x.isoformat()).cast("timestamp_ntz") for x in (lo, hi)]
    zero = F.lit(0)
    if grain in _MONTHS:
        months = (hi.year - lo.year) * 12 + hi.month - lo.month
        n, step = months // _MONTHS[grain] + 1, F.col("id") * _MONTHS[grain]
        t = start + F.make_ym_interval(zero, step.cast("int"))
    else:
        n = (hi - lo) // timedelta(seconds=_SECONDS[grain]) + 1
        step = (F.col("id") * _SECONDS[grain]).cast("decimal(18,6)")
        t = start + F.make_dt_interval(zero, zero, zero, step)
    return spark.range(max(n, 0)).select(t.alias("t")).filter(F.col("t") <= end)


def truncate(time: str | Column, grain: str) -> Column:
    """Start of the grain as `timestamp_ntz`."""
    t = F.col(time) if isinstance(time, str) else time
    if grain in _DATE_GRAINS:
        return F.trunc(F.to_date(t), grain).cast("timestamp_ntz")
    day = F.to_date(t).cast("timestamp_ntz")
    if grain == "day":
        return day
    zero = F.lit(0)
    if grain == "hour":
        return day + F.make_dt_interval(zero, F.hour(t), zero, zero)
    if grain == "minute":
        return day + F.make_dt_interval(zero, F.hour(t), F.minute(t), zero)
    raise ValueError(f"unknown grain {grain!r}; one of {GRAINS}")


def as_instant(time: Column) -> Column:
    """A local time as the instant at which clocks in UTC show it, in any session time zone."""
    day = F.unix_date(F.to_date(time)).cast("bigint") * F.lit(86_400)
    whole = day + F.hour(time) * F.lit(3600) + F.minute(time) * F.lit(60)
    part = (F.extract(F.lit("SECOND"), time) * F.lit(1_000_000)).cast("bigint")
    return F.timestamp_micros(whole * F.lit(1_000_000) + part)


def as_local(instant: Column) -> Column:
    """What clocks in UTC show at an instant, as `timestamp_ntz`, in any session time zone."""
    zero, micros = F.lit(0), F.unix_micros(instant)
    part = (micros.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, part)


def seconds(df: DataFrame, time: str) -> Column:
    """Whole seconds since 1970 of a date or timestamp column, as bigint."""
    t, kind = F.col(time), df.schema[time].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(t)
    days = F.unix_date(F.to_date(t)).cast("bigint") * F.lit(86_400)
    if isinstance(kind, T.DateType):
        return days
    return days + F.hour(t) * F.lit(3600) + F.minute(t) * F.lit(60) + F.second(t)


def time_bucket(df: DataFrame, time: str, width: int) -> Column:
    """Number of the span of `width` whole seconds a time lies in."""
    return F.floor(seconds(df, time) / F.lit(width)).cast("bigint")
