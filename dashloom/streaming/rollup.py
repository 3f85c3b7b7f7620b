"""Keeping a rollup table up to date from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.rollups import BATCH, commit_part, entries, write_rollup


def stream_rollup(stream: DataFrame, path: str, checkpoint: str,
                  build: Callable[[DataFrame], DataFrame],
                  trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    """Write the rollup of every batch as a part of its own, named by stream, batch and day.

    Sums and sketches merge when read (`merge_rollup`), so a day that arrives over
    several batches needs no read of what is there. A part is listed in the table's ledger once it
    is written; a batch that is run again after a failure replaces its own files if it was not
    listed and does nothing if it was, so nothing is counted twice or lost.

    A stream is known by the id that its checkpoint holds: a new checkpoint, also in the same
    folder, is another stream, whose batches are added. Give a `name` to replay a stream from its first file
    under a new checkpoint: each batch then replaces the part of that name and number. Once
    such a part has been merged by `compact_parts` it can no longer be replaced, and a replay ends with an error.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        part = f"{name or run}-{batch_id}"
        known = entries(spark, path)
        if any(e["part"] == part and e["run"] == run for e in known):
            return
        if any(part in e["covers"] for e in known):
            raise ValueError(f"part {part} has been merged with others; replay into a new table")
        write_rollup(build(batch).withColumn(BATCH, F.lit(part)), path, parts=[BATCH])
        commit_part(spark, path, part, run)

    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
