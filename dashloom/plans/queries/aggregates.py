"""Tiles, breakdowns, subtotals, pivots, distributions, profiles."""

from pyspark.sql import functions as F

from ...functions.grain import truncate
from ...functions.measures import mean, revenue, rows, total
from ...operators import aggregates as A
from ...operators.filters import derive, json_dim
from ...operators.joins import star
from ...sources.tables import load, table
from ..registry import query
from .sql import ORDER_TOTAL, REVENUE, VALUE_TOTAL


@query("kpi", f"""
select count(*) as n_lines, count(distinct l_orderkey) as n_orders, {REVENUE} as revenue,
       cast(sum(cast(l_quantity as decimal(12,2))) as double) as quantity,
       cast(sum(cast(l_quantity as decimal(12,2))) as double) / count(*) as avg_quantity,
       max(l_shipdate) as last_ship
from lineitem""")
def tiles(spark, sf_dir):
    return A.kpi(table(spark, sf_dir, "lineitem"), {
        "n_lines": rows(), "n_orders": F.count_distinct("l_orderkey"), "revenue": revenue(),
        "quantity": total("l_quantity"), "avg_quantity": mean("l_quantity"),
        "last_ship": F.max("l_shipdate")})


@query("breakdown", f"""
select l_returnflag, l_linestatus, count(*) as n, {REVENUE} as revenue,
       cast(sum(cast(l_quantity as decimal(12,2))) as double) as quantity,
       cast(sum(cast(l_discount as decimal(12,2))) as double) / count(*) as avg_discount
from lineitem group by all""")
def by_flag(spark, sf_dir):
    return A.breakdown(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {
        "n": rows(), "revenue": revenue(), "quantity": total("l_quantity"),
        "avg_discount": mean("l_discount")})


_ORDER_MEASURES = f"count(*) as n, {ORDER_TOTAL} as total"


def _order_measures():
    return {"n": rows(), "total": total("o_totalprice")}


@query("subtotals", f"""
select o_orderstatus, o_orderpriority,
       cast(grouping(o_orderstatus, o_orderpriority) as bigint) as level, {_ORDER_MEASURES}
from orders group by rollup (o_orderstatus, o_orderpriority)""")
def order_subtotals(spark, sf_dir):
    return A.subtotals(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"],
                       _order_measures())


@query("cross_totals", f"""
select o_orderstatus, o_orderpriority,
       cast(grouping(o_orderstatus, o_orderpriority) as bigint) as level, {_ORDER_MEASURES}
from orders group by cube (o_orderstatus, o_orderpriority)""")
def order_cube(spark, sf_dir):
    return A.cross_totals(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"],
                          _order_measures())


@query("grouping_sets", f"""
with d as (select event_type, cast(dayofweek(ts) + 1 as varchar) as weekday, value from events)
select event_type, weekday, cast(grouping(event_type, weekday) as bigint) as level,
       count(*) as n, {VALUE_TOTAL} as value
from d group by grouping sets ((event_type), (weekday), ())""")
def event_sets(spark, sf_dir):
    events = derive(table(spark, sf_dir, "events"), weekday=F.dayofweek("ts").cast("string"))
    return A.grouping_sets(events, [["event_type"], ["weekday"], []],
                           {"n": rows(), "value": total("value")})


_STATUSES = ["F", "O", "P"]


@query("matrix", "select o_orderpriority, " + ", ".join(
    f"cast(sum(cast(o_totalprice as decimal(12,2))) filter (o_orderstatus = '{s}') as double) as \"{s}\""
    for s in _STATUSES) + " from orders group by all")
def priority_matrix(spark, sf_dir):
    return A.matrix(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus",
                    _STATUSES, total("o_totalprice"))


@query("melt", f"""
with d as (select l_returnflag, cast(count(*) as double) as n, {REVENUE} as revenue,
                  cast(sum(cast(l_quantity as decimal(12,2))) as double) as quantity
           from lineitem group by all)
select l_returnflag, 'n' as metric, n as value from d union all
select l_returnflag, 'revenue', revenue from d union all
select l_returnflag, 'quantity', quantity from d""")
def long_metrics(spark, sf_dir):
    wide = A.breakdown(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {
        "n": rows().cast("double"), "revenue": revenue(), "quantity": total("l_quantity")})
    return A.melt(wide, ["l_returnflag"], ["n", "revenue", "quantity"])


@query("percentiles", """
select o_orderstatus, quantile_cont(o_totalprice, 0.25) as p25,
       quantile_cont(o_totalprice, 0.5) as p50, quantile_cont(o_totalprice, 0.95) as p95
from orders group by all""")
def order_percentiles(spark, sf_dir):
    return A.percentiles(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice",
                         [0.25, 0.5, 0.95])


@query("percentiles_approx", """
select o_orderstatus, count(*) as n, true as p50_ok, true as p95_ok from orders group by all""")
def order_percentiles_approx(spark, sf_dir):
    """The approximate values with their true rank checked against the promise."""
    orders = table(spark, sf_dir, "orders")
    found = A.percentiles_approx(orders, ["o_orderstatus"], "o_totalprice", [0.5, 0.95])
    rated = orders.join(found, "o_orderstatus")
    price, facts = F.col("o_totalprice"), {"n": rows()}
    for name in ("p50", "p95"):
        facts[f"{name}_lt"] = F.count_if(price < F.col(name))
        facts[f"{name}_le"] = F.count_if(price <= F.col(name))
    ranks = A.breakdown(rated, ["o_orderstatus"], facts)
    slack = F.col("n") * 0.001 + 1
    return ranks.select("o_orderstatus", "n", *[
        ((F.col(f"{name}_lt") <= F.col("n") * p + slack)
         & (F.col(f"{name}_le") >= F.col("n") * p - slack)).alias(f"{name}_ok")
        for name, p in (("p50", 0.5), ("p95", 0.95))])


@query("histogram", """
select event_type, floor(value / 25.0::double) * 25.0::double as bin_start, count(*) as n
from events group by all""")
def value_histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), "value", 25.0, ["event_type"])


@query("distinct", """
select event_type, cast(date_trunc('day', ts) as timestamp) as day,
       count(distinct user_id) as n_distinct
from events group by all""")
def daily_users(spark, sf_dir):
    return A.distinct(table(spark, sf_dir, "events"),
                      ["event_type", truncate("ts", "day").alias("day")], "user_id")


@query("distinct_approx", """
select l_returnflag, count(distinct l_orderkey) as exact, true as approx_ok
from lineitem group by all""")
def approx_orders(spark, sf_dir):
    """Approximate beside exact counts; the error has to stay below 5 times the 1 % asked for."""
    lines = table(spark, sf_dir, "lineitem")
    approx = A.distinct(lines, ["l_returnflag"], "l_orderkey", approx=True, rsd=0.01)
    exact = A.distinct(lines, ["l_returnflag"], "l_orderkey").withColumnRenamed(
        "n_distinct", "exact")
    error = F.abs(F.col("n_distinct") - F.col("exact"))
    return approx.join(exact, "l_returnflag").select(
        "l_returnflag", "exact", (error <= F.col("exact") * 0.05).alias("approx_ok"))


@query("merge_distinct", """
select event_type, count(distinct user_id) as exact, true as merged_ok
from events group by all""")
def merged_sketches(spark, sf_dir):
    """Sketches per day merged to the whole time, beside the exact count."""
    events = table(spark, sf_dir, "events")
    daily = A.distinct_sketch(events, [F.to_date("ts").alias("day"), "event_type"], "user_id")
    merged = A.merge_distinct(daily, ["event_type"])
    exact = A.distinct(events, ["event_type"], "user_id").withColumnRenamed("n_distinct", "exact")
    error = F.abs(F.col("n_distinct") - F.col("exact"))
    return merged.join(exact, "event_type").select(
        "event_type", "exact", (error <= F.col("exact") * 0.05).alias("merged_ok"))


@query("facets", " union all ".join(
    f"select '{c}' as facet, {c} as value, count(*) as n from orders group by all"
    for c in ("o_orderstatus", "o_orderpriority")))
def order_facets(spark, sf_dir):
    return A.facets(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


_PROFILED = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("profile", " union all ".join(f"""
select '{c}' as "column", count(*) as n_rows, count(*) - count({c}) as n_nulls,
       count(distinct {c}) as n_distinct, cast(min({c}) as varchar) as min_value,
       cast(max({c}) as varchar) as max_value from customer""" for c in _PROFILED))
def customer_profile(spark, sf_dir):
    return A.profile(table(spark, sf_dir, "customer"), _PROFILED)


@query("first_last", """
select user_id, arg_min(value, (ts, event_id)) as first_value,
       arg_max(value, (ts, event_id)) as last_value
from events group by all""")
def first_and_last(spark, sf_dir):
    return A.first_last(table(spark, sf_dir, "events"), ["user_id"], "value", "ts", "event_id")


@query("label_rates", """
select lang, source, count(*) as n_docs, count(l.doc_id) as n_labelled,
       avg(cast(quality as double)) as quality_rate, avg(cast(toxic as double)) as toxic_rate
from documents d left join labels l on d.doc_id = l.doc_id group by all""")
def document_labels(spark, sf_dir):
    t = load(spark, sf_dir, "documents", "labels")
    return A.label_rates(t["documents"], t["labels"], ["lang", "source"])


@query("spread", """
select l_returnflag, round(stddev_samp(l_quantity), 9) as stddev_a,
       round(stddev_samp(l_extendedprice), 9) as stddev_b,
       round(corr(l_quantity, l_extendedprice), 9) as correlation
from lineitem group by all""")
def line_spread(spark, sf_dir):
    """Rounded far below any digit shown: the last bits depend on the order of the rows."""
    found = A.spread(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity",
                     "l_extendedprice")
    return found.select("l_returnflag", *[F.round(c, 9).alias(c)
                                          for c in ("stddev_a", "stddev_b", "correlation")])


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("json_matrix", f"""
select cast(json_extract_string(props, '$.k') as bigint) as k,
       {', '.join(f"count(*) filter (event_type = '{t}') as {t}" for t in _TYPES)}
from events group by all""")
def json_by_type(spark, sf_dir):
    events = json_dim(table(spark, sf_dir, "events"), "props", "$.k", "bigint")
    return A.matrix(events, ["k"], "event_type", _TYPES, rows()).fillna(0, _TYPES)


@query("star_subtotals", f"""
select r_name, n_name, c_mktsegment,
       cast(grouping(r_name, n_name, c_mktsegment) as bigint) as level, {_ORDER_MEASURES}
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
group by rollup (r_name, n_name, c_mktsegment)""")
def market_subtotals(spark, sf_dir):
    t = load(spark, sf_dir, "orders", "customer", "nation", "region")
    orders = star(t["orders"], (t["customer"], ("o_custkey", "c_custkey")),
                  (t["nation"], ("c_nationkey", "n_nationkey")),
                  (t["region"], ("n_regionkey", "r_regionkey")))
    return A.subtotals(orders, ["r_name", "n_name", "c_mktsegment"],
                       {"n": rows(), "total": total("o_totalprice")})
