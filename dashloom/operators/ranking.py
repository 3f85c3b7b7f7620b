"""Top lists, shares and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import _literal
from .ordered import CHUNK, running_sums, split_in_order


def pareto(df: DataFrame, dim: str, measure: Column, tiles: int = 4,
           parts: int | None = None) -> DataFrame:
    """Share, cumulative share, tile and percent rank of each dimension value.

    The largest value comes first, the dimension breaks ties. The dimension is numbered
    and summed up in chunks, as it may have as many values as there are customers.
    The measure should be an integer or a decimal.
    """
    grouped = df.groupBy(dim).agg(measure.alias("value"))
    order = (F.col("value").desc(), F.col(dim))
    chunks, one = split_in_order(grouped, [], order, parts), F.lit(1).cast("bigint")
    numbered = running_sums(chunks, order, {"_upto": one, "_sum": F.col("value")})
    # The rank is where a run of equal values starts. A chunk's first run may have begun in earlier
    # chunks, at the end of each: so many rows of it came before, from one row for each chunk.
    runs = chunks.groupBy(CHUNK, F.struct("value").alias("_run")).agg(F.count(F.lit(1)).alias("_n"))  # a null is a value too
    tails = runs.groupBy(CHUNK).agg(F.max("_run").alias("_first"), F.min("_run").alias("_last"), F.min_by("_n", "_run").alias("_tail"))
    earlier = tails.select(F.col(CHUNK).alias("_chunk2"), F.col("_last").alias("_first"), F.col("_tail").alias("_tail2"))
    begun = (tails.select(CHUNK, "_first").join(earlier, "_first").filter(F.col("_chunk2") < F.col(CHUNK))
             .groupBy(CHUNK, "_first").agg(F.sum("_tail2").alias("_begun")))
    run_start = F.min("_upto").over(W.partitionBy(CHUNK, "value")) - 1
    ranked = numbered.join(begun, CHUNK, "left").withColumn("_rank", run_start - F.when(
        F.struct("value") == F.col("_first"), F.coalesce("_begun", F.lit(0))).otherwise(0))
    n, at = F.col("_upto_total"), F.col("_upto")
    size, extra = F.floor(n / tiles), n % tiles
    long = extra * (size + 1)  # rows in the tiles that hold one more
    tile = F.when(at <= long, F.ceil(at / (size + 1))).otherwise(
        extra + F.ceil(F.try_divide(at - long, size)))
    total = F.col("_sum_total").cast("double")
    return ranked.select(
        dim, F.col("value").cast("double").alias("value"),
        F.try_divide(F.col("value").cast("double"), total).alias("share"),
        F.try_divide(F.col("_sum").cast("double"), total).alias("cum_share"),
        tile.cast("bigint").alias("tile"),
        F.coalesce(F.try_divide(F.col("_rank").cast("double"), (n - 1).cast("double")),
                   F.lit(0.0)).alias("pct_rank"))


def top_per_group(df: DataFrame, group: Sequence[str], dim: str, measure: Column,
                  n: int, salts: int = 64) -> DataFrame:
    """The n largest dimension values of each group, `rank_no` from 1.

    Before a group meets in one task its rows are cut to a multiple of n. Spark itself cuts
    each task's rows to n per group, up to an n of its own limit; for a larger n the group is
    first dealt to `salts` tasks, and each keeps n.
    """
    grouped = df.groupBy(*group, dim).agg(measure.alias("value"))
    order = (F.col("value").desc(), F.col(dim))
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        dealt = grouped.withColumn("_salt", F.pmod(F.xxhash64(dim), F.lit(salts)))
        place = F.row_number().over(W.partitionBy(*group, "_salt").orderBy(*order))
        grouped = dealt.withColumn("_place", place).filter(F.col("_place") <= n).drop("_salt", "_place")
    return (grouped.withColumn("rank_no", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
            .filter(F.col("rank_no") <= n))


def top_n_other(df: DataFrame, dim: str, measures: Mapping[str, Column], by: str,
                n: int, combine=F.sum, other: str = "Other") -> DataFrame:
    """The n largest values of a dimension and one row for all others.

    `is_other` tells that row from a value of the same name. Measures are combined
    with `combine`, so they must be additive. Spark decides by size how the n top rows
    are joined to mark the others.
    """
    grouped = df.groupBy(dim).agg(*[c.alias(m) for m, c in measures.items()])
    # The dimension makes the order complete. The measures behind it keep both uses
    # of `grouped` alike, so that Spark computes it once.
    top = (grouped.orderBy(F.col(by).desc(), F.col(dim), *measures).limit(n)
           .select(F.col(dim).alias("_top")).withColumn("_in", F.lit(True)))
    marked = grouped.join(top, F.col(dim).eqNullSafe(F.col("_top")), "left")
    is_other = F.col("_in").isNull()
    return marked.groupBy(
        F.when(is_other, F.lit(other)).otherwise(F.col(dim).cast("string")).alias(dim),
        is_other.alias("is_other"),
    ).agg(*[combine(m).alias(m) for m in measures])


def _after(df: DataFrame, name: str, way: str, value: Any) -> tuple[Column, Column, Column]:
    """Whether a row comes after, at, or not before a value; nulls come last."""
    c = F.col(name)
    if value is None:
        return F.lit(False), c.isNull(), c.isNull()
    v = _literal(value, df.schema[name].dataType)
    if way == "asc":
        return (c > v) | c.isNull(), c == v, (c >= v) | c.isNull()
    return (c < v) | c.isNull(), c == v, (c <= v) | c.isNull()


def rows_after(df: DataFrame, order: Sequence[tuple[str, str]],
               cursor: Mapping[str, Any] | None, n: int) -> DataFrame:
    """The next page of rows after the cursor.

    `order` is (column, "asc" | "desc"), nulls last, and must end in a column that
    is unique. The cursor holds these columns of the last row seen. Earlier pages
    are skipped by a filter at the scan, not by counting.
    """
    if cursor is not None:
        steps, equal = [], F.lit(True)
        for name, way in order:
            later, same, _ = _after(df, name, way, cursor[name])
            steps.append(equal & later)
            equal = equal & same
        # Implied by the steps; as a plain comparison it reaches the scan.
        first, way = order[0]
        df = df.filter(_after(df, first, way, cursor[first])[2])
        df = df.filter(reduce(lambda a, b: a | b, steps))
    keys = [F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_last()
            for c, way in order]
    return df.orderBy(*keys).limit(n)
