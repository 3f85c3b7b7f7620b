"""User-defined dimensions and measures."""

import pandas as pd
from pyspark.sql import functions as F

from ...functions.custom import custom_measure, register_dimension, register_measure
from ...functions.measures import cents, exact_sum, rows, total
from ...operators.aggregates import breakdown
from ...sources.tables import table
from ..registry import query

_WEIGHTED = """
select l_returnflag,
       cast(sum(cast(round(l_extendedprice * 100) as bigint) * cast(l_quantity as bigint)) as double)
       / cast(sum(cast(l_quantity as bigint)) as double) / 100 as mean_price
from lineitem group by all"""


@query("register_measure", """
select l_returnflag,
       cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_quantity as decimal(12,2))) as double)
       / cast(sum(cast(l_quantity as decimal(12,2))) as double) as mean_price
from lineitem group by all""")
def weighted_mean(spark, sf_dir):
    def ratio(part: pd.Series, whole: pd.Series) -> pd.Series:
        return part / whole

    mean = register_measure(spark, "weighted_mean", ratio, "double")
    weighted = exact_sum(cents("l_extendedprice") * cents("l_quantity"), 4).cast("double")
    sums = breakdown(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {
        "_part": weighted, "_whole": total("l_quantity")})
    return sums.select("l_returnflag", mean("_part", "_whole").alias("mean_price"))


@query("custom_measure", _WEIGHTED)
def weighted_mean_in_python(spark, sf_dir):
    def partial(group: pd.DataFrame) -> dict:
        cents = (group.l_extendedprice * 100).round().astype("int64")
        weight = group.l_quantity.astype("int64")
        return {"part": int((cents * weight).sum()), "whole": int(weight.sum())}

    def finish(part: pd.Series, whole: pd.Series) -> pd.Series:
        return part.astype("float64") / whole.astype("float64") / 100

    return custom_measure(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_extendedprice", "l_quantity"],
        partial, {"part": ("bigint", F.sum), "whole": ("bigint", F.sum)}, finish, "double",
        "mean_price")


@query("register_dimension", """
select case when p_retailprice < 1000 then 'low' when p_retailprice < 1500 then 'middle'
            else 'high' end as band, count(*) as n
from part group by all""")
def price_bands(spark, sf_dir):
    def band(price: pd.Series) -> pd.Series:
        return pd.cut(price, [0, 1000, 1500, float("inf")], right=False,
                      labels=["low", "middle", "high"]).astype(str)

    price_band = register_dimension(spark, "price_band", band, "string")
    parts = table(spark, sf_dir, "part").withColumn("band", price_band("p_retailprice"))
    return breakdown(parts, ["band"], {"n": rows()})
