"""Live panels. Streams carry event time as `timestamp`, results as `timestamp_ntz`.

In append mode a window or session is written once its end is not after the
watermark, the latest event time seen less `delay`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from threading import Event

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.grain import as_local
from ..session import new_path


def _bounds(windowed: DataFrame, col: str, start: str, end: str) -> DataFrame:
    rest = [c for c in windowed.columns if c != col]
    return windowed.select(
        as_local(F.col(f"{col}.start")).alias(start), as_local(F.col(f"{col}.end")).alias(end), *rest)


def live_series(stream: DataFrame, time: str, size: str, delay: str,
                measures: Mapping[str, Column], dims: Sequence[str] = ()) -> DataFrame:
    """Measures per window of `size`."""
    return live_sliding(stream, time, size, None, delay, measures, dims)


def live_sliding(stream: DataFrame, time: str, size: str, slide: str | None, delay: str,
                 measures: Mapping[str, Column], dims: Sequence[str] = ()) -> DataFrame:
    """Measures per window of `size`, a new one every `slide`."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = (stream.withWatermark(time, delay)
               .groupBy(window.alias("_window"), *dims)
               .agg(*[c.alias(n) for n, c in measures.items()]))
    return _bounds(grouped, "_window", "window_start", "window_end")


def live_sessions(stream: DataFrame, user: str, time: str, gap: str, delay: str,
                  measures: Mapping[str, Column]) -> DataFrame:
    """Sessions as they close.

    With `spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition` a
    busy user's events are merged before the shuffle (see `session.SETTINGS`).
    """
    grouped = (stream.withWatermark(time, delay)
               .groupBy(F.session_window(time, gap), user)
               .agg(*[c.alias(n) for n, c in measures.items()]))
    return _bounds(grouped, "session_window", "session_start", "session_end")


def live_dedup(stream: DataFrame, time: str, keys: Sequence[str], delay: str,
               salts: int = 8) -> DataFrame:
    """One row per key among copies at most `delay` apart.

    Copies are first dropped within `salts` groups made of the input partition, so
    that very many copies of one key do not meet in one task; then what is left,
    at most `salts` rows per key. `salts=1` leaves the first step out.
    """
    marked = stream.withWatermark(time, delay)
    if salts > 1:
        salt = F.spark_partition_id() % salts
        marked = (marked.withColumn("_salt", salt)
                  .dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt"))
    return marked.dropDuplicatesWithinWatermark(list(keys))


def _copies(df: DataFrame, salts: int) -> DataFrame:
    """Every row once for each salt."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _salted(df: DataFrame, salts: int) -> DataFrame:
    """Every row with a salt that depends on its content only."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))


def live_enrich(stream: DataFrame, dim: DataFrame, on: tuple[str, str],
                how: str = "inner", salts: int = 1) -> DataFrame:
    """Add the columns of a static table.

    Spark broadcasts a small table. For one that is too large for that, `salts`
    spreads the rows of a busy key over as many tasks, at the price of as many
    copies of the table in the shuffle.
    """
    left, right = on
    dim = dim.withColumnRenamed(right, left)
    if salts == 1:
        return stream.join(dim, left, how)
    return _salted(stream, salts).join(_copies(dim, salts), [left, "_salt"], how).drop("_salt")


def live_within(a: DataFrame, b: DataFrame, key: str, a_time: str, b_time: str,
                delta: str, delay: str, salts: int = 4) -> DataFrame:
    """Pairs of the same key where b is 0 to `delta` after a.

    State is kept for `delta` and `delay` only. Rows of `b` are spread over `salts`
    groups and rows of `a` are sent to all of them, so a busy key takes `salts`
    tasks; `a` should be the smaller stream.
    """
    span = F.expr(f"INTERVAL {delta}")
    left = _copies(a.withWatermark(a_time, delay), salts)
    right = (_salted(b.withWatermark(b_time, delay), salts)
             .withColumnsRenamed({key: "_key_b", "_salt": "_salt_b"}))
    match = ((F.col(key) == F.col("_key_b")) & (F.col("_salt") == F.col("_salt_b"))
             & (F.col(b_time) >= F.col(a_time)) & (F.col(b_time) <= F.col(a_time) + span))
    return left.join(right, match).drop("_salt", "_salt_b", "_key_b")


def late_dropped(query: StreamingQuery) -> int:
    """Rows dropped as late so far.

    Spark counts them after partial aggregation, so this is a sign of late data
    and not the number of late events. A query keeps its last progress records only (100 by
    default); `LateRows` counts over all of them.
    """
    return sum(op["numRowsDroppedByWatermark"]
               for p in query.recentProgress for op in p["stateOperators"])


class LateRows(StreamingQueryListener):
    """Adds up the late rows of every progress record of every query, from when it is registered.

    `with LateRows(spark) as late: ...; late.total(query)`. Counts are those of `late_dropped`, but
    none is forgotten however long the query runs.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.dropped, self.batches, self.ended = spark, Counter(), Counter(), {}

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self.ended[str(event.runId)] = Event()

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.batches[run] += 1
        self.dropped[run] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event()).set()

    def total(self, query: StreamingQuery, wait: float = 60) -> int:
        """Late rows of this run of the query; where it has ended, once all its records have come in."""
        run = str(query.runId)
        if not query.isActive and not self.ended.setdefault(run, Event()).wait(wait):
            raise TimeoutError("the end of the query has not been reported")
        return self.dropped[run]


def drain(stream: DataFrame, mode: str = "append", name: str = "live") -> DataFrame:
    """Run a stream over the input there is now and return what it wrote."""
    spark = stream.sparkSession
    base = new_path(spark, name)
    out, writer = f"{base}/out", stream.writeStream.outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        spark.createDataFrame([], stream.schema).write.parquet(out)
        writer = writer.foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(out))
    query = (writer.option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
