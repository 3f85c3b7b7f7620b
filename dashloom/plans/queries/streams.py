"""Live panels, each run over the events there are."""

from pyspark.sql import functions as F

from ...functions.grain import as_local
from ...functions.measures import cents, from_cents, rows, total
from ...operators.aggregates import breakdown
from ...session import new_path
from ...sources.tables import event_stream, table
from ...streaming import live as L
from ..registry import query
from .sql import EVENT_VALUE, VALUE_TOTAL

# In append mode a window or session is out once its end is not after this.
_MARK = "(select max(ts) - interval 1 hour from events)"


def _measures():
    return {"n": rows(), "value": F.sum(cents("value"))}


def _plain(df):
    return df.withColumn("value", from_cents("value"))


@query("live_series", f"""
with w as (select cast(date_trunc('hour', ts) as timestamp) as window_start, count(*) as n,
                  {VALUE_TOTAL} as value from events group by all)
select window_start, window_start + interval 1 hour as window_end, n, value
from w where window_end <= {_MARK}""")
def live_hours(spark, sf_dir):
    return _plain(L.drain(L.live_series(event_stream(spark, sf_dir), "ts", "1 hour", "1 hour",
                                        _measures())))


@query("live_series_complete", f"""
select cast(date_trunc('hour', ts) as timestamp) as window_start, window_start + interval 1 hour
       as window_end, event_type, count(*) as n, {VALUE_TOTAL} as value from events group by all""")
def live_hours_complete(spark, sf_dir):
    series = L.live_series(event_stream(spark, sf_dir), "ts", "1 hour", "1 hour", _measures(),
                           ["event_type"])
    return _plain(L.drain(series, "complete"))


@query("live_sliding", f"""
with s as (select event_type, value, time_bucket(interval 15 minute, ts)
                  - to_minutes(15 * unnest([0, 1, 2, 3])) as window_start from events)
select window_start, window_start + interval 1 hour as window_end, event_type, count(*) as n,
       {VALUE_TOTAL} as value
from s where window_start + interval 1 hour <= {_MARK} group by all""")
def live_sliding_hours(spark, sf_dir):
    return _plain(L.drain(L.live_sliding(
        event_stream(spark, sf_dir), "ts", "1 hour", "15 minutes", "1 hour", _measures(),
        ["event_type"])))


@query("live_sessions", f"""
with f as (select *, case when ts > lag(ts) over w + interval 30 minute
                            or lag(ts) over w is null then 1 else 0 end as starts
           from events window w as (partition by user_id order by ts, event_id)),
     s as (select *, sum(starts) over (partition by user_id order by ts, event_id) as session_no
           from f),
     g as (select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end,
                  count(*) as n, cast(sum({EVENT_VALUE}) as double) as value
           from s group by user_id, session_no)
select * from g where session_end <= {_MARK}""")
def live_user_sessions(spark, sf_dir):
    return _plain(L.drain(L.live_sessions(event_stream(spark, sf_dir), "user_id", "ts",
                                          "30 minutes", "1 hour", _measures())))


@query("live_dedup", f"""
select event_type, count(*) as n, {VALUE_TOTAL} as value from events group by all""")
def live_without_copies(spark, sf_dir):
    """The event stream joined by a second copy of itself, and freed from it again."""
    twice = event_stream(spark, sf_dir).union(event_stream(spark, sf_dir))
    once = L.drain(L.live_dedup(twice, "ts", ["event_id"], "1 hour")
                   .select("event_id", "event_type", "value"))
    return breakdown(once, ["event_type"], {"n": rows(), "value": total("value")})


@query("live_enrich", f"""
select c_mktsegment, c_nationkey, count(*) as n, {VALUE_TOTAL} as value
from events join customer on user_id = c_custkey group by all""")
def live_segments(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    enriched = L.live_enrich(event_stream(spark, sf_dir).select("user_id", "value"), customers,
                             ("user_id", "c_custkey"))
    return breakdown(L.drain(enriched), ["c_mktsegment", "c_nationkey"],
                     {"n": rows(), "value": total("value")})


@query("live_within", """
with a as (select event_id as click_id, user_id, ts as click_ts from events where event_type = 'click'),
     b as (select event_id as buy_id, user_id as bu, ts as buy_ts from events where event_type = 'purchase')
select user_id, click_id, click_ts, buy_id, buy_ts
from a join b on user_id = bu and buy_ts >= click_ts and buy_ts <= click_ts + interval 1 hour""")
def live_click_then_buy(spark, sf_dir):
    clicks = event_stream(spark, sf_dir).filter("event_type = 'click'").select(
        F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    buys = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("buy_id"), "user_id", F.col("ts").alias("buy_ts"))
    pairs = L.drain(L.live_within(clicks, buys, "user_id", "click_ts", "buy_ts", "1 hour",
                                  "1 hour"))
    return pairs.select("user_id", "click_id", as_local(F.col("click_ts")).alias("click_ts"),
                        "buy_id", as_local(F.col("buy_ts")).alias("buy_ts"))


@query("late_dropped", "select count(*) as n_late from events where ts < timestamp '2024-01-10'")
def late_events(spark, sf_dir):
    """Events of the first days come in after the last days' were seen: all are late."""
    events, path = table(spark, sf_dir, "events"), new_path(spark, "late")
    for part in ("ts >= timestamp_ntz'2024-01-20' and ts < timestamp_ntz'2024-01-25'", "ts >= timestamp_ntz'2024-01-25'",
                 "ts < timestamp_ntz'2024-01-10'"):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{path}/events")  # a file is a batch
    stream = event_stream(spark, f"{path}/events", "*.parquet", max_files=1)
    with L.LateRows(spark) as late:
        seen = L.live_dedup(stream, "ts", ["event_id"], "1 hour", salts=1)
        run = (seen.writeStream.format("parquet").option("path", f"{path}/out")
               .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
        run.awaitTermination()
        n = late.total(run)
    return spark.createDataFrame([(n,)], "n_late long")
