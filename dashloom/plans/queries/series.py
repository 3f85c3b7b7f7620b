"""Time series and their windows."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from ...functions.measures import cents, from_cents, net_units, revenue, rows, total
from ...operators import series as S
from ...sources.tables import table
from ..registry import query
from .sql import EVENT_VALUE, NET_PRICE, ORDER_TOTAL, REVENUE, VALUE_TOTAL

_MONTHS = f"""
select cast(date_trunc('month', o_orderdate) as timestamp) as t, count(*) as n,
       {ORDER_TOTAL} as total from orders group by all"""


def _months(spark, sf_dir):
    return S.series(table(spark, sf_dir, "orders"), "o_orderdate", "month",
                    {"n": rows(), "total": total("o_totalprice")})


@query("series", _MONTHS)
def monthly_orders(spark, sf_dir):
    return _months(spark, sf_dir)


@query("series_hours", f"""
select cast(date_trunc('hour', ts) as timestamp) as t, event_type, count(*) as n,
       {VALUE_TOTAL} as value from events group by all""")
def hourly_events(spark, sf_dir):
    return S.series(table(spark, sf_dir, "events"), "ts", "hour",
                    {"n": rows(), "value": total("value")}, ["event_type"])


@query("fill_gaps", f"""
with s as (select cast(date_trunc('hour', ts) as timestamp) as t, event_type, count(*) as n,
                  {VALUE_TOTAL} as value from events group by all),
     spine as (select distinct event_type, unnest(generate_series(
         timestamp '2024-01-01', timestamp '2024-01-30 23:00:00', interval 1 hour)) as t from events)
select spine.t, spine.event_type, coalesce(n, 0) as n, coalesce(value, 0) as value
from spine left join s on spine.t = s.t and spine.event_type = s.event_type""")
def hourly_without_gaps(spark, sf_dir):
    points = hourly_events(spark, sf_dir)
    return S.fill_gaps(points, "hour", datetime(2024, 1, 1), datetime(2024, 1, 30, 23),
                       ["event_type"])


@query("vs_previous", f"""
with m as ({_MONTHS}),
     c as (select t, n, total, lag(total, 12) over (order by t) as previous from m)
select t, n, total, previous, total - previous as change,
       case when previous = 0 then null else (total - previous) * 100.0::double / previous end
         as change_pct
from c""")
def year_over_year(spark, sf_dir):
    months = S.fill_gaps(_months(spark, sf_dir), "month", date(1995, 1, 1), date(2001, 8, 1))
    return S.vs_previous(months, "total", 12)


_CENTS = f"""
select cast(date_trunc('day', ts) as timestamp) as t, event_type,
       cast(sum({EVENT_VALUE}) * 100 as bigint) as cents
from events group by all"""


def _cents(spark, sf_dir):
    return S.series(table(spark, sf_dir, "events"), "ts", "day",
                    {"cents": F.sum(cents("value"))}, ["event_type"])


@query("moving", f"""
select t, event_type, cents, avg(cents) over (partition by event_type order by t
       rows between 6 preceding and current row) as moving_avg from ({_CENTS})""")
def weekly_average(spark, sf_dir):
    return S.moving(_cents(spark, sf_dir), "cents", 7, ["event_type"])


@query("running", f"""
select t, event_type, cents, cast(sum(cents) over (partition by event_type order by t) as bigint)
       as running_total from ({_CENTS})""")
def running_value(spark, sf_dir):
    return S.running(_cents(spark, sf_dir), "cents", ["event_type"])


@query("rolling", f"""
with r as (select user_id, ts as t,
  cast(sum({EVENT_VALUE}) over w as double) as value, count(*) over w as n
  from events window w as (partition by user_id order by ts
                           range between interval 7 day preceding and current row))
select distinct user_id, t, value, n from r""")
def user_week(spark, sf_dir):
    found = S.rolling(table(spark, sf_dir, "events"), ["user_id"], "ts", timedelta(days=7),
                      {"value": cents("value"), "n": F.lit(1)})
    return found.withColumn("value", from_cents("value"))


@query("rolling_days", f"""
with d as (select l_returnflag, l_shipdate as t, sum({NET_PRICE}) as v, count(*) as c
           from lineitem group by all)
select l_returnflag, t, cast(sum(v) over w as double) as revenue,
       cast(sum(c) over w as bigint) as n
from d window w as (partition by l_returnflag order by t
                    range between interval 30 day preceding and current row)""")
def shipping_month(spark, sf_dir):
    found = S.rolling(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_shipdate",
                      timedelta(days=30), {"revenue": net_units(), "n": F.lit(1)})
    return found.withColumn("revenue", F.col("revenue").cast("double") / 10_000.0)


@query("zscore", f"""
with c as (select *, avg(cents) over w as trail_avg, stddev_samp(cents) over w as trail_std
           from ({_CENTS}) window w as (partition by event_type order by t
                                        rows between 7 preceding and 1 preceding))
select t, event_type, cents, round(trail_avg, 6) as trail_avg, round(trail_std, 6) as trail_std,
       round(case when trail_std = 0 then null else (cents - trail_avg) / trail_std end, 9) as zscore
from c""")
def unusual_days(spark, sf_dir):
    """Rounded far below any digit shown: the two engines differ in the last bits."""
    found = S.zscore(_cents(spark, sf_dir), "cents", 7, ["event_type"])
    return found.withColumns({"trail_avg": F.round("trail_avg", 6),
                              "trail_std": F.round("trail_std", 6),
                              "zscore": F.round("zscore", 9)})


@query("series_quarters", f"""
select cast(date_trunc('quarter', l_shipdate) as timestamp) as t, l_linestatus,
       {REVENUE} as revenue from lineitem group by all""")
def quarterly_revenue(spark, sf_dir):
    return S.series(table(spark, sf_dir, "lineitem"), "l_shipdate", "quarter",
                    {"revenue": revenue()}, ["l_linestatus"])
