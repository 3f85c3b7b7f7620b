"""Panels described at run time."""

from datetime import datetime

from pyspark.sql import functions as F

from ...functions.measures import cents, from_cents, net_total, revenue, rows, total
from ...operators.filters import Filter
from ...session import new_path
from ...sources.rollups import daily_rollup, write_rollup
from ...sources.tables import table
from ..dashboard import Dashboard, Tile, run_dashboard
from ..panel import Join, Panel, run_panel
from ..registry import query
from .sql import NET_PRICE, ORDER_TOTAL, REVENUE, VALUE_TOTAL


@query("run_panel", f"""
select r_name, count(*) as n, {REVENUE} as revenue
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'
  and c_mktsegment in ('BUILDING', 'FURNITURE') and l_returnflag = 'R'
group by all order by revenue desc, r_name limit 3""")
def best_regions(spark, sf_dir):
    return run_panel(spark, sf_dir, Panel(
        source="lineitem",
        joins=(Join("orders", "l_orderkey", "o_orderkey"),
               Join("customer", "o_custkey", "c_custkey"),
               Join("nation", "c_nationkey", "n_nationkey"),
               Join("region", "n_regionkey", "r_regionkey")),
        filters=(Filter("o_orderdate", "between", (datetime(1997, 1, 1), datetime(1998, 1, 1))),
                 Filter("c_mktsegment", "in", ("BUILDING", "FURNITURE")),
                 Filter("l_returnflag", "eq", "R")),
        dims=("r_name",), measures={"n": rows(), "revenue": revenue()},
        order=("-revenue", "r_name"), limit=3))


@query("run_panel_series", f"""
select cast(date_trunc('month', o_orderdate) as timestamp) as t, c_mktsegment, count(*) as n,
       {ORDER_TOTAL} as total
from orders join customer on o_custkey = c_custkey group by all""")
def segment_months(spark, sf_dir):
    return run_panel(spark, sf_dir, Panel(
        source="orders", joins=(Join("customer", "o_custkey", "c_custkey"),),
        grain=("o_orderdate", "month"), dims=("c_mktsegment",),
        measures={"n": rows(), "total": total("o_totalprice")}))


@query("run_panel_derived", f"""
select cast(date_trunc('week', ts) as timestamp) as t, cast(hour(ts) as bigint) as hour_of_day,
       count(*) as n, count(distinct user_id) as n_users, {VALUE_TOTAL} as value
from events where event_type in ('click', 'purchase') group by all""")
def busy_hours(spark, sf_dir):
    return run_panel(spark, sf_dir, Panel(
        source="events", filters=(Filter("event_type", "in", ("click", "purchase")),),
        derived={"hour_of_day": F.hour("ts").cast("bigint")},
        grain=("ts", "week"), dims=("hour_of_day",),
        measures={"n": rows(), "n_users": F.count_distinct("user_id"), "value": total("value")}))


@query("run_panel_tiles", f"select count(*) as n, {ORDER_TOTAL} as total from orders")
def order_tiles(spark, sf_dir):
    return run_panel(spark, sf_dir, Panel(
        source="orders", measures={"n": rows(), "total": total("o_totalprice")}))


@query("run_panel_top", f"""
with g as (select c_mktsegment, sum({NET_PRICE}) as v, count(*) as n
           from lineitem join orders on l_orderkey = o_orderkey
             join customer on o_custkey = c_custkey
           where l_shipdate >= timestamp '1998-01-01' group by all),
     r as (select *, row_number() over (order by v desc, c_mktsegment) > 2 as is_other from g)
select case when is_other then 'Other' else c_mktsegment end as c_mktsegment, is_other,
       cast(sum(v) as double) as revenue, cast(sum(n) as bigint) as n
from r group by 1, 2""")
def best_segments(spark, sf_dir):
    found = run_panel(spark, sf_dir, Panel(
        source="lineitem",
        joins=(Join("orders", "l_orderkey", "o_orderkey"),
               Join("customer", "o_custkey", "c_custkey")),
        filters=(Filter("l_shipdate", "between", (datetime(1998, 1, 1), None)),),
        dims=("c_mktsegment",), measures={"revenue": net_total(), "n": rows()},
        top=("revenue", 2)))
    return found.withColumn("revenue", F.col("revenue").cast("double"))


@query("run_panel_rollup", f"""
select cast(date_trunc('week', ts) as timestamp) as t, event_type, count(*) as n,
       {VALUE_TOTAL} as value
from events where ts >= timestamp '2024-01-08' group by all""")
def weeks_from_rollup(spark, sf_dir):
    path = new_path(spark, "rollup")
    write_rollup(daily_rollup(table(spark, sf_dir, "events"), "ts", ["event_type"],
                              {"value": cents("value")}, "user_id"), path)
    found = run_panel(spark, sf_dir, Panel(
        source="events", rollup=path, grain=("day", "week"), dims=("event_type",),
        filters=(Filter("day", "between", (datetime(2024, 1, 8).date(), None)),),
        measures={"n": F.sum("n"), "value": F.sum("value")}))
    return found.withColumn("value", from_cents("value"))


_FACT = """
with f as (select * from lineitem join orders on l_orderkey = o_orderkey
             join customer on o_custkey = c_custkey where l_shipdate >= timestamp '1997-01-01')"""
_TILE = f"count(*) as n, {REVENUE} as revenue"


@query("run_dashboard", f"""{_FACT}
select 'totals' as tile, 0::bigint as level, null as c_mktsegment, null as l_returnflag,
       null as l_linestatus, null as o_orderpriority, {_TILE} from f
union all select 'returned', 0, c_mktsegment, null, null, null, {_TILE} from f
  where l_returnflag = 'R' and l_quantity >= 10 group by c_mktsegment
union all select 'drill', cast(grouping(l_returnflag, l_linestatus) as bigint), null, l_returnflag,
       l_linestatus, null, {_TILE} from f group by rollup (l_returnflag, l_linestatus)
union all select 'l_returnflag', 0, null, l_returnflag, null, null, {_TILE} from f group by l_returnflag
union all select 'o_orderpriority', 0, null, null, null, o_orderpriority, {_TILE} from f
  group by o_orderpriority""")
def sales_dashboard(spark, sf_dir):
    return run_dashboard(spark, sf_dir, Dashboard(
        source="lineitem",
        joins=(Join("orders", "l_orderkey", "o_orderkey"), Join("customer", "o_custkey", "c_custkey")),
        filters=(Filter("l_shipdate", "between", (datetime(1997, 1, 1), None)),),
        measures={"n": rows(), "revenue": revenue()},
        tiles=(Tile("totals"),
               Tile("returned", ("c_mktsegment",), (Filter("l_returnflag", "eq", "R"), Filter("big", "eq", True))),
               Tile("drill", ("l_returnflag", "l_linestatus"), subtotals=True)),
        derived={"big": F.col("l_quantity") >= 10},
        facets=("l_returnflag", "o_orderpriority")))
