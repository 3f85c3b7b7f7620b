"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Partition counts and memory belong to the cluster, so they are not set here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # State larger than the heap; merging sessions before the shuffle.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def builder(app: str = "dashloom", **conf: str) -> SparkSession.Builder:
    """A session builder with the library's settings; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set on the context, or the warehouse.

    All three are folders that a cluster's executors share; what is used does not depend on
    the master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return base or spark.conf.get("spark.sql.warehouse.dir")


def _locate(spark: SparkSession, path: str):
    """File system and path object of a path, local or shared."""
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(sc._jsc.hadoopConfiguration()), found


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, found = _locate(spark, path)
    return fs.exists(found) and fs.getFileStatus(found).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all in it, if it is there."""
    fs, found = _locate(spark, path)
    fs.delete(found, True)


def own_dir(spark: SparkSession) -> str:
    """The folder in the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/dashloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that nothing else uses."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete the application's folder, once none of its results is needed any more."""
    delete(spark, own_dir(spark))


def freeze(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where several branches must see the same rows in the same chunks, also
    when an executor is lost. Parquet lets each branch read only its columns.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
