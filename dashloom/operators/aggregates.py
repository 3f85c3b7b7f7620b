"""Tiles, breakdowns, subtotals, pivots, distributions, profiles.

Measures are a mapping from name to aggregate column, dimensions are column
names or aliased columns. Sums, counts, minima and sketches are combined before
the shuffle, so a hot group reaches its reducer as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Dim = str | Column
Measures = Mapping[str, Column]


def _named(measures: Measures) -> list[Column]:
    return [c.alias(name) for name, c in measures.items()]


def kpi(df: DataFrame, measures: Measures) -> DataFrame:
    """One row of tiles, all from one scan."""
    return df.agg(*_named(measures))


def breakdown(df: DataFrame, dims: Sequence[Dim], measures: Measures) -> DataFrame:
    return df.groupBy(*dims).agg(*_named(measures))


def subtotals(df: DataFrame, dims: Sequence[str], measures: Measures) -> DataFrame:
    """Drill-down levels; `level` tells a subtotal from a null dimension."""
    return df.rollup(*dims).agg(F.grouping_id().alias("level"), *_named(measures))


def cross_totals(df: DataFrame, dims: Sequence[str], measures: Measures) -> DataFrame:
    """Totals over every combination of dimensions."""
    return df.cube(*dims).agg(F.grouping_id().alias("level"), *_named(measures))


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]],
                  measures: Measures) -> DataFrame:
    """Totals over the chosen combinations only."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    columns = [[F.col(d) for d in s] for s in sets]
    return df.groupingSets(columns, *dims).agg(
        F.grouping_id().alias("level"), *_named(measures))


def matrix(df: DataFrame, rows: Sequence[str], col: str, values: Sequence[str],
           measure: Column) -> DataFrame:
    """One column per given value; the values are never looked up by a scan."""
    return df.groupBy(*rows).pivot(col, list(values)).agg(measure)


def melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics in long form: ids, metric, value."""
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def _rank_column(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def percentiles(df: DataFrame, dims: Sequence[str], col: str, ps: Sequence[float],
                parts: int | None = None) -> DataFrame:
    """Exact interpolated percentiles, one column p<percent> each.

    Two scans and no global order. A sketch per group cuts its values into `parts` of about
    equal rank (10,000 by default) and gives a bracket that surely holds each wanted rank. The second scan
    counts what is below and above each bracket and keeps the values inside, equal ones counted before the
    shuffle: about 4 in `parts` of a group's values for each percentile, which are put in order.
    """
    parts, margin = parts or 10_000, 2.0 / (parts or 10_000)
    wanted = [min(max(x, 0.0), 1.0) for p in ps for x in (p - margin, p + margin)]
    rows = df.select(*dims, F.col(col).cast("double").alias("_v"))
    brackets = rows.groupBy(*dims).agg(
        F.count("_v").alias("_size"), F.percentile_approx("_v", wanted, parts).alias("_at"),
        F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    ends = {0.0: F.col("_least"), 1.0: F.col("_most")}  # brackets at the ends are open
    brackets = brackets.select(*dims, "_size", F.array(*[ends.get(x, F.col("_at")[i]) for i, x in enumerate(wanted)]).alias("_at"))
    keys = {d: f"_d{i}" for i, d in enumerate(dims)}
    same = [F.col(d).eqNullSafe(F.col(k)) for d, k in keys.items()]
    brackets = brackets.withColumnsRenamed(keys)
    bracketed = rows.join(brackets, same) if same else rows.crossJoin(brackets)  # one row without dimensions
    v, sides = F.col("_v"), []
    for i in range(len(ps)):
        lo, hi = F.col("_at")[2 * i], F.col("_at")[2 * i + 1]
        side = F.when(v < lo, -1).when(v > hi, 1).otherwise(0)
        sides.append(F.struct(F.lit(i).alias("i"), side.alias("side"), F.when(side == 0, v).alias("at")))
    # A group without values stays, with nulls.
    placed = F.explode_outer(F.when(v.isNotNull(), F.array(*sides))).alias("_s")
    counted = (bracketed.select(*dims, "_size", "_v", placed).groupBy(*dims, "_size", "_s")
               .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")))
    so_far = (W.partitionBy(*dims, "_s.i").orderBy("_s.side", "_s.at")
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counted.withColumn("_upto", F.sum("_n").over(so_far))
    side, first, last = F.col("_s.side"), F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    picks, result = [], []
    for i, p in enumerate(ps):
        name, pos = _rank_column(p), F.lit(float(p)) * (F.col("_size") - 1).cast("double")
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            # Beside the bracket only the neighbouring value is known; the sketch's bound makes that enough.
            value = (F.when(side == 0, F.col("_s.at")).when((side < 0) & (at == last), F.col("_max"))
                     .when((side > 0) & (at == first), F.col("_min"))
                     .otherwise(F.raise_error(F.lit("a percentile is outside its bracket"))))
            hit = (F.col("_s.i") == i) & (first <= at) & (at <= last)
            picks.append(F.max(F.when(hit, value)).alias(f"{name}_{end}"))
        part = pos - F.floor(pos).cast("double")
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        result.append((lo + (hi - lo) * part).alias(name))
    return ranked.groupBy(*dims, "_size").agg(*picks).select(*dims, *result)


def percentiles_approx(df: DataFrame, dims: Sequence[str], col: str,
                       ps: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Percentiles from mergeable summaries, rank error at most 1/accuracy."""
    found = F.percentile_approx(col, [float(p) for p in ps], accuracy).alias("_found")
    names = [_rank_column(p) for p in ps]
    return df.groupBy(*dims).agg(found).select(
        *dims, *[F.col("_found")[i].alias(n) for i, n in enumerate(names)])


def histogram(df: DataFrame, col: str, width: float,
              dims: Sequence[str] = ()) -> DataFrame:
    """Rows per bin of the given width."""
    bin_start = F.floor(F.col(col) / F.lit(width)).cast("double") * F.lit(width)
    return df.groupBy(*dims, bin_start.alias("bin_start")).agg(
        F.count(F.lit(1)).alias("n"))


def distinct(df: DataFrame, dims: Sequence[Dim], col: str, approx: bool = False,
             rsd: float = 0.05) -> DataFrame:
    """Distinct values per group: exact, or a sketch that shuffles no values."""
    n = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return df.groupBy(*dims).agg(n.alias("n_distinct"))


def distinct_sketch(df: DataFrame, dims: Sequence[Dim], col: str,
                    lg_k: int = 12) -> DataFrame:
    """A mergeable distinct-count sketch per group."""
    return df.groupBy(*dims).agg(F.hll_sketch_agg(col, lg_k).alias("sketch"))


def merge_distinct(df: DataFrame, dims: Sequence[Dim], sketch: str = "sketch") -> DataFrame:
    """Distinct counts of coarser groups from stored sketches."""
    merged = F.hll_sketch_estimate(F.hll_union_agg(sketch))
    return df.groupBy(*dims).agg(merged.alias("n_distinct"))


def distinct_bitmaps(df: DataFrame, dims: Sequence[Dim], col: str) -> DataFrame:
    """Exact, mergeable distinct counts of a whole-number column: a bitmap for each group and bucket.

    A bucket is 32,768 neighbouring numbers and takes 4 kB, so this suits ids that lie close. No
    value is shuffled, only bitmaps, combined in each task first. Nulls do not count.
    """
    n = F.col(col).cast("bigint")
    return df.filter(n.isNotNull()).groupBy(*dims, F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bitmap"))


def merge_bitmaps(df: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """Distinct counts of coarser groups from stored bitmaps; exact, as bits are merged by OR."""
    merged = df.groupBy(*dims, "bucket").agg(F.bitmap_or_agg("bitmap").alias("_bitmap"))
    names = [c for c in merged.columns if c not in ("bucket", "_bitmap")]
    return merged.groupBy(*names).agg(F.sum(F.bitmap_count("_bitmap")).alias("n_distinct"))


def facets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per value of each column, from one scan."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return (texts.unpivot([], list(cols), "facet", "value")
            .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")))


def profile(df: DataFrame, cols: Sequence[str] | None = None,
            approx: bool = False) -> DataFrame:
    """Per column: rows, nulls, distinct values, least and greatest value as text.

    One scan. With `approx` one aggregate. Exact counts deal each row's values to their columns and
    combine equal ones in each task, so what is shuffled is a row for each distinct value of a
    column and task, with its count and as many fields as the columns have types.
    """
    cols = list(cols or df.columns)
    if approx:
        facts = [F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("n_rows"),
            (F.count(F.lit(1)) - F.count(c)).alias("n_nulls"),
            F.approx_count_distinct(c).alias("n_distinct"),
            F.min(c).cast("string").alias("min_value"),
            F.max(c).cast("string").alias("max_value")) for c in cols]
        return df.agg(F.array(*facts).alias("_facts")).selectExpr("inline(_facts)")
    kinds = {c: df.schema[c].dataType for c in cols}
    fields = {k: f"v{i}" for i, k in enumerate(dict.fromkeys(k.simpleString() for k in kinds.values()))}
    values = [F.struct(F.lit(i).alias("i"), *[
        (F.col(c) if kinds[c].simpleString() == k else F.lit(None)).cast(k).alias(v) for k, v in fields.items()])
        for i, c in enumerate(cols)]
    dealt = df.select(F.explode(F.array(*values)).alias("_value"))
    counted = (dealt.groupBy(*[F.col(f"_value.{v}").alias(v) for v in ("i", *fields.values())])
               .agg(F.count(F.lit(1)).alias("_n")))
    known = F.coalesce(*[F.when(F.col(v).isNotNull(), True) for v in fields.values()], F.lit(False))
    # A column has values in the field of its type only.
    found = counted.groupBy("i").agg(
        F.sum("_n").alias("n_rows"), F.sum(F.when(known, 0).otherwise(F.col("_n"))).alias("n_nulls"),
        F.count(F.when(known, 1)).alias("n_distinct"),
        F.coalesce(*[F.min(v).cast("string") for v in fields.values()]).alias("min_value"),
        F.coalesce(*[F.max(v).cast("string") for v in fields.values()]).alias("max_value"))
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in cols])).alias("i", "column"))
    zero = F.lit(0).cast("bigint")
    return names.join(found, "i", "left").select(
        "column", *[F.coalesce(n, zero).alias(n) for n in ("n_rows", "n_nulls", "n_distinct")], "min_value", "max_value")


def first_last(df: DataFrame, dims: Sequence[str], col: str, time: str,
               tie: str | None = None) -> DataFrame:
    """First and last value by time, the tie-break deciding equal times.

    Rows without a time do not count.
    Without a tie-break numbers are aggregated by hashing; with one, Spark sorts
    the rows of a task by group first.
    """
    at = F.col(time)
    order = F.when(at.isNotNull(), F.struct(time, tie)) if tie else at
    return df.groupBy(*dims).agg(
        F.min_by(col, order).alias("first_value"), F.max_by(col, order).alias("last_value"))


def label_rates(docs: DataFrame, labels: DataFrame, dims: Sequence[str],
                key: str = "doc_id", flags: Sequence[str] = ("quality", "toxic")) -> DataFrame:
    """Documents, labelled documents, and the rate of each 0/1 label among them."""
    labelled = labels.withColumn("_labelled", F.lit(1))
    joined = docs.select(key, *dims).join(labelled, key, "left")
    rates = [F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags]
    return joined.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("_labelled").alias("n_labelled"), *rates)


def spread(df: DataFrame, dims: Sequence[str], a: str, b: str) -> DataFrame:
    """Standard deviation of two columns and their correlation."""
    return df.groupBy(*dims).agg(
        F.stddev_samp(a).alias("stddev_a"), F.stddev_samp(b).alias("stddev_b"),
        F.corr(a, b).alias("correlation"))
