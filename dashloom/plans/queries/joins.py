"""Star joins, segments, as-of, interval match, orphans, set operations."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ...functions.measures import revenue, rows, total
from ...operators.aggregates import breakdown
from ...operators.filters import Filter, apply_filters
from ...operators.joins import (asof_latest, in_segment, not_in_segment, orphans, star, within)
from ...operators.sets import members, period_diff, stack
from ...sources.tables import load, table
from ..registry import query
from .sql import ORDER_TOTAL, REVENUE


@query("star_revenue", f"""
select r_name, n_name, {REVENUE} as revenue
from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'
group by r_name, n_name""")
def star_revenue(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    orders = apply_filters(
        t["orders"], [Filter("o_orderdate", "between", (datetime(1996, 1, 1), datetime(1997, 1, 1)))])
    lines = star(t["lineitem"], (orders, ("l_orderkey", "o_orderkey")),
                 (t["customer"], ("o_custkey", "c_custkey")),
                 (t["nation"], ("c_nationkey", "n_nationkey")),
                 (t["region"], ("n_regionkey", "r_regionkey")))
    return breakdown(lines, ["r_name", "n_name"], {"revenue": revenue()})


@query("star", f"""
select p_brand, s_nationkey, count(*) as n, {REVENUE} as revenue
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
group by all""")
def star_parts(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem", "part", "supplier")
    lines = star(t["lineitem"], (t["part"], ("l_partkey", "p_partkey")),
                 (t["supplier"], ("l_suppkey", "s_suppkey")))
    return breakdown(lines, ["p_brand", "s_nationkey"], {"n": rows(), "revenue": revenue()})


def _segment(spark, sf_dir):
    return apply_filters(table(spark, sf_dir, "customer"),
                         [Filter("c_mktsegment", "in", ["BUILDING", "MACHINERY"])])


_SEGMENT = "(select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))"


@query("in_segment", f"""
select o_orderpriority, count(*) as n, {ORDER_TOTAL} as total
from orders where o_custkey in {_SEGMENT} group by all""")
def segment_orders(spark, sf_dir):
    orders = in_segment(table(spark, sf_dir, "orders"), _segment(spark, sf_dir),
                        ("o_custkey", "c_custkey"))
    return breakdown(orders, ["o_orderpriority"], {"n": rows(), "total": total("o_totalprice")})


@query("not_in_segment", f"""
select o_orderpriority, count(*) as n, {ORDER_TOTAL} as total
from orders where o_custkey not in {_SEGMENT} group by all""")
def other_orders(spark, sf_dir):
    orders = not_in_segment(table(spark, sf_dir, "orders"), _segment(spark, sf_dir),
                            ("o_custkey", "c_custkey"))
    return breakdown(orders, ["o_orderpriority"], {"n": rows(), "total": total("o_totalprice")})


@query("asof_latest", """
with p as (select event_id, user_id, ts, value from events where event_type = 'purchase'),
     v as (select event_id as view_id, user_id as vu, ts as view_ts, value as view_value
           from events where event_type = 'view')
select event_id, user_id, ts, value, coalesce(view_id, -1) as view_id, view_ts, view_value
from p asof left join v on p.user_id = v.vu and p.ts >= v.view_ts""")
def last_view(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = apply_filters(events, [Filter("event_type", "eq", "purchase")]).select(
        "event_id", "user_id", "ts", "value")
    viewed = apply_filters(events, [Filter("event_type", "eq", "view")]).select(
        F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"),
        F.col("value").alias("view_value"))
    found = asof_latest(bought, viewed, "user_id", "ts", "view_ts", "view_id",
                        ["view_id", "view_ts", "view_value"])
    return found.fillna(-1, ["view_id"])


@query("within", """
with a as (select event_id as click_id, user_id, ts as click_ts from events where event_type = 'click'),
     b as (select event_id as buy_id, user_id as bu, ts as buy_ts from events where event_type = 'purchase')
select user_id, click_id, click_ts, buy_id, buy_ts
from a join b on user_id = bu and buy_ts >= click_ts and buy_ts <= click_ts + interval 6 hour""")
def click_then_buy(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    buys = events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("buy_id"), "user_id", F.col("ts").alias("buy_ts"))
    return within(clicks, buys, "user_id", "click_ts", "buy_ts", timedelta(hours=6)).select(
        "user_id", "click_id", "click_ts", "buy_id", "buy_ts")


@query("orphans", """
with o as (select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem))
select count(*) as orphan_rows, count(distinct o_orderkey) as orphan_keys from o""")
def orders_without_line(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem", "orders")
    return orphans(t["orders"], t["lineitem"], ("o_orderkey", "l_orderkey"))


def _year(df, year):
    return apply_filters(df, [Filter("o_orderdate", "between",
                                     (datetime(year, 1, 1), datetime(year + 1, 1, 1)))])


@query("period_diff", """
with a as (select o_custkey, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as before
           from orders where year(o_orderdate) = 1996 group by all),
     b as (select o_custkey, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as after
           from orders where year(o_orderdate) = 1997 group by all)
select coalesce(a.o_custkey, b.o_custkey) as o_custkey, before, after,
       case when a.o_custkey is null then 'added' when b.o_custkey is null then 'removed'
            when before = after then 'same' else 'changed' end as status
from a full join b on a.o_custkey = b.o_custkey""")
def customers_compared(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return period_diff(_year(orders, 1996), _year(orders, 1997), "o_custkey",
                       total("o_totalprice"))


def _members(op):
    def run(spark, sf_dir):
        orders = table(spark, sf_dir, "orders")
        a, b = (_year(orders, y).select("o_custkey") for y in (1996, 1997))
        return members(a, b, op)
    return run


for _op, _word in (("both", "intersect"), ("either", "union"), ("only_first", "except"),
                   ("only_first_all", "except all")):
    query(f"members_{_op}", f"""
select o_custkey from orders where year(o_orderdate) = 1996
{_word} select o_custkey from orders where year(o_orderdate) = 1997""")(_members(_op))


@query("stack", """
select 'customer' as kind, c_nationkey as nationkey, count(*) as n,
       cast(sum(cast(c_acctbal as decimal(12,2))) as double) as balance
from customer group by all
union all
select 'supplier', s_nationkey, count(*), null from supplier group by all""")
def parties(spark, sf_dir):
    t = load(spark, sf_dir, "customer", "supplier")
    return stack(
        breakdown(t["customer"], [F.lit("customer").alias("kind"),
                                  F.col("c_nationkey").alias("nationkey")],
                  {"n": rows(), "balance": total("c_acctbal")}),
        breakdown(t["supplier"], [F.lit("supplier").alias("kind"),
                                  F.col("s_nationkey").alias("nationkey")], {"n": rows()}))
