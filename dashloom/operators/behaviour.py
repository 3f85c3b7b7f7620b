"""Sessions, funnels and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grain import time_bucket


def sessions(df: DataFrame, user: str, time: str, gap: timedelta,
             sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Sessions of a user: a pause longer than `gap` starts a new one.

    Same sessions as `session_window`. Rows of a user in the same time bucket, no
    wider than `gap`, are always in one session, so they are combined before the
    shuffle, and the window over a user sees one row per bucket: as many as gaps
    fit into the time range, however busy the user is. Gaps are a second or more.
    """
    sums, width = sums or {}, gap // timedelta(seconds=1)
    if width < 1:
        raise ValueError("the gap must be at least one second")
    bucket = time_bucket(df, time, width)
    short = df.filter(F.col(time).isNotNull()).groupBy(user, bucket.alias("_bucket")).agg(
        F.min(time).alias("_first"), F.max(time).alias("_last"),
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{m}") for m, c in sums.items()])
    w = W.partitionBy(user).orderBy("_bucket")
    end = F.lag("_last").over(w) + F.lit(gap)
    starts = F.when(end >= F.col("_first"), 0).otherwise(1)
    numbered = short.withColumn("_starts", starts).withColumn(
        "_session", F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (numbered.groupBy(user, "_session")
            .agg(F.min("_first").alias("session_start"),
                 (F.max("_last") + F.lit(gap)).alias("session_end"),
                 F.sum("_n").alias("n_events"),
                 *[F.sum(f"_s_{m}").alias(m) for m in sums])
            .drop("_session"))


def funnel_times(df: DataFrame, user: str, time: str, kind: str,
                 steps: Sequence[str], bucket: timedelta = timedelta(hours=1)) -> DataFrame:
    """Per user that did the first step: the time each step was reached, t1, t2, ...

    A step counts at its first event after the step before was reached. The events are read
    once, for any number of steps. Those of a user in one time bucket become one transition: for each step a user
    may have reached before, the step after the bucket and the times of those between. Transitions
    of a user follow each other, a row for each bucket with events: as many as buckets fit into the
    time range, however busy the user is. A task holds the events of one user's bucket at most;
    `bucket` is a second or more. Rows without a user or a time do not count.
    """
    width = bucket // timedelta(seconds=1)
    if width < 1:
        raise ValueError("the bucket must be at least one second")
    n, at = len(steps), df.schema[time].dataType
    none = F.array().cast(T.ArrayType(at))
    fits = F.array(*[F.col(kind).eqNullSafe(F.lit(s)) for s in steps])
    events = (df.filter(F.col(user).isNotNull() & F.col(time).isNotNull() & F.col(kind).isin(list(steps)))
              .select(user, time_bucket(df, time, width).alias("_bucket"), F.struct(F.col(time).alias("t"), fits.alias("fits")).alias("_e")))

    def later(state: Column, event: Column) -> Column:
        """The state after an event: one step on if it is the next step's and after the last."""
        after = (F.size(state["times"]) == 0) | (event["t"] > F.element_at(state["times"], -1))
        next_step = (state["step"] < n) & F.get(event["fits"], state["step"]) & after
        return F.when(F.coalesce(next_step, F.lit(False)), F.struct(
            (state["step"] + 1).alias("step"), F.concat(state["times"], F.array(event["t"])).alias("times"))).otherwise(state)

    start = F.array(*[F.struct(F.lit(i).alias("step"), none.alias("times")) for i in range(n)])
    in_bucket = F.aggregate(F.array_sort("_events"), start, lambda states, e: F.transform(states, lambda s: later(s, e)))
    moves = events.groupBy(user, "_bucket").agg(F.collect_list("_e").alias("_events")).select(user, "_bucket", in_bucket.alias("_move"))
    # A transition in which nobody gets on is left out before the second shuffle.
    moves = moves.filter(F.exists("_move", lambda s: F.size(s["times"]) > 0))
    one = F.struct(F.lit(0).alias("step"), none.alias("times"))

    def follow(state: Column, move: Column) -> Column:
        done = F.get(move["_move"], state["step"])
        return F.when(state["step"] >= n, state).otherwise(F.struct(
            done["step"].alias("step"), F.concat(state["times"], done["times"]).alias("times")))

    chain = F.array_sort(F.collect_list(F.struct("_bucket", "_move")))
    found = moves.groupBy(user).agg(chain.alias("_moves")).select(user, F.aggregate("_moves", one, follow)["times"].alias("_times"))
    return found.filter(F.size("_times") > 0).select(user, *[F.get("_times", F.lit(i)).alias(f"t{i + 1}") for i in range(n)])


def funnel(df: DataFrame, user: str, time: str, kind: str, steps: Sequence[str]) -> DataFrame:
    """Users that reached each step, in all and as part of the first step."""
    times = funnel_times(df, user, time, kind, steps)
    counts = times.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(1, len(steps) + 1)])
    rows = [F.struct(F.lit(i).cast("bigint").alias("step_no"), F.lit(s).alias("step"),
                     F.col(f"n{i}").alias("n_users"),
                     F.try_divide(F.col(f"n{i}").cast("double"),
                                  F.col("n1").cast("double")).alias("rate"))
            for i, s in enumerate(steps, start=1)]
    return counts.select(F.inline(F.array(*rows)))


def retention(df: DataFrame, user: str, time: str) -> DataFrame:
    """Users active n days after the day they were first seen, per first day.

    A user's rows are reduced to distinct days before anything is done per user.
    Rows without a user or a time do not count.
    """
    df = df.filter(F.col(user).isNotNull() & F.col(time).isNotNull())
    days = df.select(user, F.to_date(time).alias("day")).distinct()
    first = F.min("day").over(W.partitionBy(user))
    return (days.withColumn("cohort", first)
            .withColumn("day_no", F.datediff("day", "cohort").cast("bigint"))
            .groupBy("cohort", "day_no").agg(F.count(F.lit(1)).alias("n_users")))
