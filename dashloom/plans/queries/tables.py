"""Sources, rollup tables, filters and derived columns."""

from datetime import datetime

from pyspark.sql import functions as F

from ...functions.grain import GRAINS, truncate
from ...functions.measures import cents, from_cents, rows, total
from ...operators.aggregates import breakdown, distinct_bitmaps, kpi, merge_bitmaps
from ...operators.filters import Filter, apply_filters, derive, json_dim, json_dims
from ...operators.sets import stack
from ...session import new_path
from ...sources.rollups import (daily_rollup, merge_rollup, read_rollup, write_rollup)
from ...sources.tables import TABLES, event_stream, load, table
from ...streaming.live import drain
from ...streaming.rollup import stream_rollup
from ..registry import query
from .sql import EVENT_VALUE, ORDER_TOTAL, VALUE_TOTAL


@query("load", " union all ".join(
    f"select '{t}' as table_name, count(*) as n from {t}" for t in TABLES))
def load_counts(spark, sf_dir):
    return stack(*[kpi(df, {"n": rows()}).select(F.lit(name).alias("table_name"), "n")
                   for name, df in load(spark, sf_dir).items()])


@query("event_stream", f"""
select event_type, count(*) as n, {VALUE_TOTAL} as value from events group by event_type""")
def event_stream_totals(spark, sf_dir):
    seen = drain(event_stream(spark, sf_dir).select("event_type", "value"))
    return breakdown(seen, ["event_type"], {"n": rows(), "value": total("value")})


def _event_rollup(df):
    return daily_rollup(df, "ts", ["event_type"], {"value": cents("value")}, "user_id")


def _days(rollup):
    merged = merge_rollup(rollup, ["day", "event_type"], ["value"])
    return merged.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n",
                         from_cents("value").alias("value"))


_DAILY = f"""
select cast(date_trunc('day', ts) as timestamp) as day, event_type, count(*) as n, {VALUE_TOTAL} as value
from events group by all"""


@query("write_rollup", _DAILY)
def rollup_table(spark, sf_dir):
    path = new_path(spark, "rollup")
    write_rollup(_event_rollup(table(spark, sf_dir, "events")), path)
    return _days(read_rollup(spark, path))


@query("stream_rollup", _DAILY)
def streamed_rollup(spark, sf_dir):
    path = new_path(spark, "rollup")
    stream = event_stream(spark, sf_dir, max_files=1)
    stream_rollup(stream, f"{path}/table", f"{path}/checkpoint", _event_rollup).awaitTermination()
    return _days(read_rollup(spark, f"{path}/table"))


@query("read_rollup", f"""
with d as (select event_type, {EVENT_VALUE} as v, user_id from events
           where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-22')
select event_type, count(*) as n, cast(sum(v) as double) as value,
       count(distinct user_id) as n_users, true as sketch_ok
from d group by event_type""")
def rollup_range(spark, sf_dir):
    """Two weeks from the rollup, the users from its sketches, beside the exact count."""
    lo, hi = datetime(2024, 1, 8), datetime(2024, 1, 22)
    events = table(spark, sf_dir, "events")
    path = new_path(spark, "rollup")
    write_rollup(_event_rollup(events), path)
    days = read_rollup(spark, path, lo.date(), hi.date())
    found = merge_rollup(days, ["event_type"], ["value"]).select(
        "event_type", "n", from_cents("value").alias("value"),
        F.hll_sketch_estimate("users").alias("_estimate"))
    exact = (apply_filters(events, [Filter("ts", "between", (lo, hi))])
             .groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users")))
    error = F.abs(F.col("_estimate") - F.col("n_users"))
    return found.join(exact, "event_type").select(
        "event_type", "n", "value", "n_users",
        (error <= F.col("n_users") * 0.05).alias("sketch_ok"))


@query("apply_filters", f"""
select o_orderstatus, count(*) as n, {ORDER_TOTAL} as total from orders
where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-07-01'
  and o_orderstatus in ('O', 'F') and o_orderpriority like '1-%'
  and o_custkey is not null and not (o_orderstatus = 'it''s -- "P"')
group by o_orderstatus""")
def filter_bar(spark, sf_dir):
    orders = apply_filters(table(spark, sf_dir, "orders"), [
        Filter("o_orderdate", "between", (datetime(1996, 1, 1), datetime(1998, 7, 1))),
        Filter("o_orderstatus", "in", ["O", "F", "it's -- \"P\""]),
        Filter("o_orderpriority", "prefix", "1-"),
        Filter("o_custkey", "not_null"),
    ])
    return breakdown(orders, ["o_orderstatus"], {"n": rows(), "total": total("o_totalprice")})


@query("derive", """
select cast(year(o_orderdate) as bigint) as order_year,
       case when o_totalprice < 100000 then 'small' when o_totalprice < 300000 then 'medium'
            else 'large' end as size, count(*) as n
from orders group by all""")
def derived_dimensions(spark, sf_dir):
    price = F.col("o_totalprice")
    orders = derive(
        table(spark, sf_dir, "orders"),
        order_year=F.year("o_orderdate").cast("bigint"),
        size=F.when(price < 100_000, "small").when(price < 300_000, "medium").otherwise("large"))
    return breakdown(orders, ["order_year", "size"], {"n": rows()})


@query("json_dim", f"""
select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n,
       {VALUE_TOTAL} as value
from events group by all""")
def json_breakdown(spark, sf_dir):
    events = json_dim(table(spark, sf_dir, "events"), "props", "$.k", "bigint")
    return breakdown(events, ["k"], {"n": rows(), "value": total("value")})


@query("grains", " union all ".join(f"""
select '{g}' as grain, cast(date_trunc('{g}', ts) as timestamp) as t, count(*) as n
from events group by all""" for g in GRAINS))
def every_grain(spark, sf_dir):
    each = [F.struct(F.lit(g).alias("grain"), truncate("ts", g).alias("t")) for g in GRAINS]
    points = table(spark, sf_dir, "events").select(F.inline(F.array(*each)))
    return breakdown(points, ["grain", "t"], {"n": rows()})


@query("json_dims", f"""
select cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.k') as k_text,
       json_extract_string(props, '$.none') as missing, count(*) as n, {VALUE_TOTAL} as value
from events group by all""")
def json_properties(spark, sf_dir):
    events = json_dims(table(spark, sf_dir, "events"), "props",
                       {"k": ("$.k", "bigint"), "k_text": ("$.k", "string"), "missing": ("$.none", "string")})
    return breakdown(events, ["k", "k_text", "missing"], {"n": rows(), "value": total("value")})


@query("merge_bitmaps", """
select event_type, cast(count(distinct user_id) as bigint) as n_distinct from events group by all""")
def exact_users_from_days(spark, sf_dir):
    """Exact users per type from bitmaps stored per day and type."""
    path = new_path(spark, "bitmaps")
    days = distinct_bitmaps(table(spark, sf_dir, "events"), [F.to_date("ts").alias("day"), "event_type"], "user_id")
    write_rollup(days, path)
    return merge_bitmaps(read_rollup(spark, path), ["event_type"])
