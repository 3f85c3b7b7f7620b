"""Top lists, shares and paging."""

from pyspark.sql import functions as F

from ...functions.measures import cents, exact_sum, net_total, rows
from ...operators.ranking import pareto, rows_after, top_n_other, top_per_group
from ...operators.joins import star
from ...sources.tables import load, table
from ..registry import query
from .sql import NET_PRICE


def _pareto_sql(dim, measure, source):
    return f"""
with g as (select {dim}, {measure} as v from {source} group by all)
select {dim}, cast(v as double) as value,
       cast(v as double) / cast(sum(v) over () as double) as share,
       cast(sum(v) over (order by v desc, {dim} rows unbounded preceding) as double)
         / cast(sum(v) over () as double) as cum_share,
       ntile(4) over (order by v desc, {dim}) as tile,
       percent_rank() over (order by v desc) as pct_rank
from g"""


@query("pareto", _pareto_sql("o_custkey", "sum(cast(o_totalprice as decimal(12,2)))", "orders"))
def customer_shares(spark, sf_dir):
    return pareto(table(spark, sf_dir, "orders"), "o_custkey", exact_sum(cents("o_totalprice")))


@query("pareto_ties", _pareto_sql("l_partkey", "count(*)", "lineitem"))
def part_shares(spark, sf_dir):
    return pareto(table(spark, sf_dir, "lineitem"), "l_partkey", rows())


@query("top_per_group", f"""
with g as (select r_name, o_custkey, sum({NET_PRICE}) as v
           from lineitem join orders on l_orderkey = o_orderkey
             join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
             join region on n_regionkey = r_regionkey group by all),
     r as (select *, row_number() over (partition by r_name order by v desc, o_custkey) as rank_no
           from g)
select r_name, o_custkey, cast(v as double) as value, rank_no from r where rank_no <= 5""")
def best_customers(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    lines = star(t["lineitem"], (t["orders"], ("l_orderkey", "o_orderkey")),
                 (t["customer"], ("o_custkey", "c_custkey")),
                 (t["nation"], ("c_nationkey", "n_nationkey")),
                 (t["region"], ("n_regionkey", "r_regionkey")))
    top = top_per_group(lines, ["r_name"], "o_custkey", net_total(), 5)
    return top.select("r_name", "o_custkey", F.col("value").cast("double").alias("value"),
                      F.col("rank_no").cast("bigint").alias("rank_no"))


@query("top_n_other", f"""
with g as (select p_brand, count(*) as n, sum({NET_PRICE}) as v
           from lineitem join part on l_partkey = p_partkey group by all),
     r as (select *, row_number() over (order by v desc, p_brand) > 7 as is_other from g)
select case when is_other then 'Other' else p_brand end as p_brand, is_other,
       cast(sum(n) as bigint) as n, cast(sum(v) as double) as revenue
from r group by 1, 2""")
def top_brands(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem", "part")
    lines = star(t["lineitem"], (t["part"], ("l_partkey", "p_partkey")))
    top = top_n_other(lines, "p_brand", {"n": rows(), "revenue": net_total()}, "revenue", 7)
    return top.withColumn("revenue", F.col("revenue").cast("double"))


@query("rows_after", """
select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders
order by o_totalprice desc, o_orderkey limit 25 offset 25""")
def second_page(spark, sf_dir):
    """The page after the first; the cursor is that page's last row."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    order = [("o_totalprice", "desc"), ("o_orderkey", "asc")]
    last = rows_after(orders, order, None, 25).collect()[-1]
    return rows_after(orders, order, last.asDict(), 25)
