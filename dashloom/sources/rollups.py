"""Rollup tables: daily pre-aggregates that answer many panels.

A table that is written in parts (by a stream, or by `compact_parts`) has a ledger beside them: a
row for each part once it is complete, with the parts that it takes the place of. Readers
see the parts that are listed and not replaced, so a part that was being written when something
failed does not count. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grain import as_local
from ..session import delete, is_folder

DAY, BATCH, LEDGER = "day", "batch_id", "_ledger"
_ENTRY = "part string, run string, level int, has_rows boolean, covers array<string>"


def daily_rollup(df: DataFrame, time: str, dims: Sequence[str],
                 sums: Mapping[str, Column], user: str, lg_k: int = 12) -> DataFrame:
    """Per day and dimensions: rows, sums, and a mergeable sketch of the users.

    An instant, as in `event_stream`, counts for the day that UTC shows, in any session time zone.
    """
    instant = isinstance(df.schema[time].dataType, T.TimestampType)
    day = F.to_date(as_local(F.col(time)) if instant else F.col(time))
    return df.groupBy(day.alias(DAY), *dims).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
        F.hll_sketch_agg(user, lg_k).alias("users"))


def write_rollup(df: DataFrame, path: str, day_col: str = DAY,
                 parts: Sequence[str] = ()) -> None:
    """Replace the days present in `df` and leave the others alone.

    The rebalance step gathers a day into few files, and splits a day that is too
    large for one task.
    """
    by = [*parts, day_col]
    (df.hint("rebalance", *by).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def read_rollup(spark: SparkSession, path: str, lo: date | None = None,
                hi: date | None = None) -> DataFrame:
    """Rollup rows from day `lo` up to, not including, `hi`; other days are not read.

    Of a table with a ledger, the parts that stand.
    """
    if is_folder(spark, f"{path}/{LEDGER}"):
        df = _read_parts(spark, path, [e["part"] for e in standing(spark, path)])
    else:
        df = spark.read.parquet(path)
    if lo is not None:
        df = df.filter(F.col(DAY) >= F.lit(lo))
    if hi is not None:
        df = df.filter(F.col(DAY) < F.lit(hi))
    return df


def merge_rollup(df: DataFrame, dims: Sequence[str | Column],
                 sums: Sequence[str]) -> DataFrame:
    """Coarser groups, or parts of one day written at different times, as one row."""
    return df.groupBy(*dims).agg(
        F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums],
        F.hll_union_agg("users").alias("users"))


def entries(spark: SparkSession, path: str) -> list:
    """The ledger's rows, one for each part ever completed: not many, as parts are merged."""
    if not is_folder(spark, f"{path}/{LEDGER}"):
        return []
    return spark.read.schema(_ENTRY).parquet(f"{path}/{LEDGER}").collect()


def standing(spark: SparkSession, path: str) -> list:
    """The ledger's rows of the parts that no other part replaces and that have rows."""
    found = entries(spark, path)
    covered = {p for e in found for p in e["covers"]}
    return list({e["part"]: e for e in found if e["has_rows"] and e["part"] not in covered}.values())


def commit_part(spark: SparkSession, path: str, part: str, run: str, level: int = 0,
                covers: Sequence[str] = ()) -> None:
    """List a part whose files are all there."""
    entry = (part, run, level, is_folder(spark, f"{path}/{BATCH}={part}"), list(covers))
    spark.createDataFrame([entry], _ENTRY).coalesce(1).write.mode("append").parquet(f"{path}/{LEDGER}")


def _read_parts(spark: SparkSession, path: str, parts: Sequence[str]) -> DataFrame:
    if not parts:
        raise ValueError(f"no part of {path} has rows")
    # Part names are text, also where they look like numbers or dates.
    return (spark.read.option("basePath", path).parquet(*[f"{path}/{BATCH}={p}" for p in sorted(parts)])
            .withColumn(BATCH, F.col(BATCH).cast("string")))


def compact_parts(spark: SparkSession, path: str, dims: Sequence[str], sums: Sequence[str],
                  fan_in: int = 8) -> list[str]:
    """Merge the new parts of a table into one, and `fan_in` merged parts of a level into one of the next.

    Only the parts that are merged are read, so a part is read once on each level: about
    log(parts) times in all. Readers change over when the new part is listed; a failure before
    that changes nothing. Returns the names of the new parts. `drop_replaced` frees the space.
    """
    done, level = [], 0
    while True:
        levels = defaultdict(list)
        for e in standing(spark, path):
            levels[e["level"]].append(e["part"])
        old = levels[level]
        if len(old) >= (2 if level == 0 else fan_in):
            part = f"level{level + 1}-{uuid.uuid4().hex}"
            merged = merge_rollup(_read_parts(spark, path, old), [DAY, *dims], sums)
            write_rollup(merged.withColumn(BATCH, F.lit(part)), path, parts=[BATCH])
            commit_part(spark, path, part, "compaction", level + 1, old)
            done.append(part)
        elif not any(higher > level for higher in levels):
            return done
        level += 1


def drop_replaced(spark: SparkSession, path: str) -> None:
    """Delete the files of replaced parts, once no reader that began before the merge is left."""
    for part in {p for e in entries(spark, path) for p in e["covers"]}:
        delete(spark, f"{path}/{BATCH}={part}")


def compact_rollup(spark: SparkSession, path: str, target: str, dims: Sequence[str],
                   sums: Sequence[str]) -> None:
    """Write the parts of a streamed rollup as one table, one row per day and dims."""
    write_rollup(merge_rollup(read_rollup(spark, path), [DAY, *dims], sums), target)
