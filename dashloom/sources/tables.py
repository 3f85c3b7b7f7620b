"""Tables and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grain import as_instant
from ..session import is_folder

# Given, so that building a panel starts no job that looks them up.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(SCHEMAS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; other names than those above get the schema their files have."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Tables by name; nothing is read until a panel needs it."""
    return {name: table(spark, sf_dir, name) for name in names or TABLES}


def event_stream(
    spark: SparkSession,
    sf_dir: str,
    files: str = "events.parquet",
    time: str = "ts",
    schema: str = SCHEMAS["events"],
    max_files: int | None = None,
) -> DataFrame:
    """Stream of events from parquet files in a folder.

    `files` may be one file, a folder of part files, or a pattern such as
    `*.parquet`. Watermarks need a time with a zone, so a `time` without one becomes the
    instant at which UTC shows it, whatever the session's zone; the live panels turn it back.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A stream starts from a folder, so one file is a folder with a filter.
    if "*" not in files and is_folder(spark, f"{sf_dir}/{files}"):
        sf_dir = f"{sf_dir}/{files}"
    else:
        reader = reader.option("pathGlobFilter", files)
    events = reader.parquet(sf_dir)
    if isinstance(events.schema[time].dataType, T.TimestampNTZType):
        events = events.withColumn(time, as_instant(F.col(time)))
    return events
