"""Ordered work on keys of any size.

Where the order is time, the rows of a key are dealt by fixed spans of time (`bucketed`). What an earlier span
passes on is one small state, and the states of a key, one for each span that has rows, are folded
in order (`carried`): no sampling, nothing is written, and however busy a key is, a task holds
one span of it. Where the order is not time, rows are cut into even chunks instead:

A window over a key puts the whole key into one task, which a key with a large share of the
table does not allow. So the rows of all keys are cut into chunks along the order (key, then
time or value). `repartitionByRange` samples the rows, so the chunks are even whatever the
keys are, and the plan is the same at every size. At a chunk border at most one key goes on,
so what has to be passed on to later chunks is at most two rows per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import freeze

CHUNK, KEY, SPREAD, BUCKET = "_chunk", "_key", "_spread", "_bucket"

# (aggregate of one chunk, fold over the chunks of a key)
State = tuple[Column, Callable[[Column], Column]]


def bucketed(df: DataFrame, by: Sequence[str], bucket: Column, parts: int | None = None) -> DataFrame:
    """`df` with `_key` (the `by` columns) and `_bucket`, each key's span of time in one partition."""
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    keyed = df.withColumns({KEY: key, BUCKET: bucket})
    return keyed.repartition(*([parts] if parts else []), KEY, BUCKET)


def in_bucket(order: Sequence[Column]) -> WindowSpec:
    """The rows of a key in a span of time, up to the current one."""
    return (W.partitionBy(KEY, BUCKET).orderBy(*order)
            .rowsBetween(W.unboundedPreceding, W.currentRow))


def carried(rows: DataFrame, states: Mapping[str, State]) -> DataFrame:
    """What a key brings into a span of time from all earlier ones: a row for each span with rows."""
    per_bucket = rows.groupBy(KEY, BUCKET).agg(*[agg.alias(name) for name, (agg, _) in states.items()])
    earlier = (W.partitionBy(KEY).orderBy(F.col(BUCKET).asc_nulls_first())
               .rowsBetween(W.unboundedPreceding, -1))
    return per_bucket.select(KEY, BUCKET, *[fold(F.col(n)).over(earlier).alias(n) for n, (_, fold) in states.items()])


def in_chunk(order: Sequence[Column]) -> WindowSpec:
    """The rows of a key in a chunk, up to the current one."""
    return (W.partitionBy(CHUNK, KEY).orderBy(*order)
            .rowsBetween(W.unboundedPreceding, W.currentRow))


def split_in_order(df: DataFrame, by: Sequence[str], order: Sequence[Column],
                   parts: int | None = None) -> DataFrame:
    """`df` with `_key` (the `by` columns) and `_chunk`, written to the shared folder.

    The number of the input partition ends the order, so that many copies of one
    row can be cut too. The chunk numbers are stored because two runs of the
    sampling need not agree.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    keyed = df.withColumn(KEY, key).withColumn(SPREAD, F.spark_partition_id())
    n = [parts] if parts else []
    ranged = keyed.repartitionByRange(*n, KEY, *order, SPREAD).drop(SPREAD)
    return freeze(ranged.withColumn(CHUNK, F.spark_partition_id()), "ordered")


def _spanning_keys(chunks: DataFrame) -> DataFrame:
    """Keys that go on from one chunk to the next: at most one per chunk border."""
    ends = chunks.groupBy(CHUNK).agg(F.min(KEY).alias("_min"), F.max(KEY).alias("_max"))
    at = W.orderBy(CHUNK)  # one row per chunk
    # Values may run downwards along the chunks, so either end may touch either.
    before = F.array(F.lag("_min").over(at), F.lag("_max").over(at))
    touching = F.array_intersect(F.array("_min", "_max"), "_before")
    return (ends.withColumn("_before", before).filter(F.col("_before")[0].isNotNull())
            .select(F.explode(touching).alias(KEY)).distinct())


def carry_over(chunks: DataFrame, states: Mapping[str, State],
               totals: Mapping[str, State] | None = None) -> DataFrame:
    """What a key brings into a chunk from its earlier chunks.

    `totals` are folded over all chunks of the key. Only keys that span chunks
    appear, at most two in a chunk. The rows of a chunk already lie by chunk and key, so a join
    with the result moves none of them, whether Spark broadcasts it or not.
    """
    totals = totals or {}
    spanning = chunks.join(F.broadcast(_spanning_keys(chunks)), KEY, "left_semi")
    per_chunk = spanning.groupBy(CHUNK, KEY).agg(
        *[agg.alias(name) for name, (agg, _) in (*states.items(), *totals.items())])
    chain = W.partitionBy(KEY).orderBy(CHUNK)
    earlier = chain.rowsBetween(W.unboundedPreceding, -1)
    whole = chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return per_chunk.select(
        CHUNK, KEY,
        *[fold(F.col(n)).over(earlier).alias(n) for n, (_, fold) in states.items()],
        *[fold(F.col(n)).over(whole).alias(n) for n, (_, fold) in totals.items()])


def _with_sums(df: DataFrame, so_far: WindowSpec, values: Mapping[str, Column]) -> DataFrame:
    whole = so_far.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.select(
        "*", *[F.sum(v).over(so_far).alias(n) for n, v in values.items()],
        *[F.sum(v).over(whole).alias(f"{n}_total") for n, v in values.items()])


def running_sums(chunks: DataFrame, order: Sequence[Column], values: Mapping[str, Column],
                 onto: DataFrame | None = None) -> DataFrame:
    """Per key: `name` = sum of value up to the row, `name_total` = sum over the key.

    As with SQL, a sum over nulls only is null. The order must be complete, as with a ROWS
    frame. Added to `onto`, which holds the rows of `chunks` with further columns.
    """
    carry = carry_over(
        chunks,
        {f"_b_{n}": (F.sum(v), F.sum) for n, v in values.items()},
        {f"_t_{n}": (F.sum(v), F.sum) for n, v in values.items()})
    out = _with_sums(chunks if onto is None else onto, in_chunk(order), values)
    out = out.join(carry, [CHUNK, KEY], "left")
    for n in values:
        before, here = F.col(f"_b_{n}"), F.col(n)
        out = (out.withColumn(n, F.coalesce(before + here, before, here))
               .withColumn(f"{n}_total", F.coalesce(f"_t_{n}", f"{n}_total"))
               .drop(f"_b_{n}", f"_t_{n}"))
    return out
