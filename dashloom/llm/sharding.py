"""Rendezvous hashing of record keys over weighted shards, with gapless slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import freeze


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins the key: the one with the smallest -ln(u) / weight.

    u in (0, 1) is drawn from a hash of the key and the shard's number, so a shard's draw does
    not depend on the others: a further shard takes only the keys it wins, and a larger
    weight takes keys only into its own shard. A null key is a key like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights have to be positive")
    key = F.coalesce(key.cast("string"), F.lit("\0null"))

    def draw(i: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 12).cast("double")
        return F.struct((-F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))).alias("draw"), F.lit(i).alias("shard"))

    return F.array_min(F.array(*(draw(i, w) for i, w in enumerate(weights))))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """Shard and slot of every document under the key law, with the shard after a change.

    `docs` needs (doc_id, text); other columns are ignored. Returns doc_id, size (UTF-8 bytes of
    the text plus 1; null text counts none), text_crc32, shard, grown_shard (under the weights
    `grown`) and slot, gapless from 0 in each shard. doc_id and the weights alone decide the
    shard, so repeated doc_ids share one; repeated rows get slots of their own. An empty
    table gives none.

    The small columns are written once with the number of the input partition each row came
    from. Rows are numbered within (shard, partition), whose size the partition bounds, so a
    doc_id that holds a third of all rows meets in no task; the offsets are sums of one count
    for each such pair. No text is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = freeze(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            shard_of(F.col("doc_id"), weights).alias("shard"), shard_of(F.col("doc_id"), grown).alias("grown_shard"),
            F.spark_partition_id().alias("part"),
        ), "shards",
    )
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("nth", F.row_number().over(own))
    return numbered.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("offset") + F.col("nth") - 1).alias("slot")
    )


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str, spread: int = 1) -> None:
    """Write the rows of `df` to one folder per shard, each by `spread` tasks at a time.

    All columns are written, those of every kind and with nulls; a column named `shard` is replaced.
    Rows without a key are in one shard; repeated rows are written as often as they are there. An empty table leaves
    a folder without files.
    """
    shard, n = shard_of(F.col(key), weights), F.lit(max(1, spread))
    spare = F.pmod(F.xxhash64(*df.columns), n)
    df.withColumn("shard", shard).repartition("shard", spare).write.partitionBy("shard").parquet(path)
