"""Token counts with a cache of digests: only distinct new texts are encoded."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze, is_folder, new_path
from .tokens import encoder
from .words import small


def _count(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in small(batches):
            n = [enc.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])
    return run


class TokenCache:
    """Counts by content digest, in one folder per version of a tokenizer file.

    The version is the digest of the file, so a changed file starts a folder of its own and
    old counts are never mixed with new ones. `folder` is kept between runs; without one, a
    new folder in the application's shared folder is used.
    """

    def __init__(self, spark: SparkSession, tokenizer: str, folder: str | None = None):
        self.spark, self.tokenizer = spark, tokenizer
        with open(tokenizer, "rb") as f:
            version = hashlib.sha256(f.read()).hexdigest()
        self.path = f"{(folder or new_path(spark, 'token-cache')).rstrip('/')}/{version}"

    def stored(self) -> DataFrame | None:
        """(digest, n_tokens); a digest appended by two runs at once is there once."""
        if not is_folder(self.spark, self.path):
            return None
        found = self.spark.read.schema("digest binary, n_tokens long").parquet(self.path)
        return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def counts(self, docs: DataFrame, limit: int = 512) -> DataFrame:
        """Token counts of whole texts: doc_id, n_bytes, n_tokens, over_limit (more than `limit`).

        `docs` needs (doc_id, text); other columns are ignored. A null text counts as empty, an
        empty one has no tokens. Content is used as it is: a normal form that changed the text
        could change the count, so null becoming empty is the whole normalisation. Repeated rows and
        equal texts are encoded once, in one row's stead, and all get their count. An empty
        table gives an empty table.

        Digests and sizes are written first; of the texts, only one row for each digest that
        the cache does not have is encoded. Where those rows are few, Spark sends their keys
        to the tasks and no text is shuffled. Counts are appended before they are used.
        """
        text = F.coalesce("text", F.lit(""))
        # Two hashes: with one, two of 10^10 rows would be taken for each other.
        keys = F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")
        digest = F.unhex(F.sha2(text, 256)).alias("digest")
        rows = freeze(docs.select("doc_id", *keys, digest, F.octet_length(text).cast("long").alias("n_bytes")), "digests")
        new = rows.groupBy("digest").agg(F.min(F.struct("k1", "k2")).alias("key"))
        if (known := self.stored()) is not None:
            new = new.join(known, "digest", "left_anti")
        texts = docs.select(*keys, text.alias("text")).join(new.select("digest", "key.*"), ["k1", "k2"]).select("digest", "text")
        counted = texts.mapInArrow(_count(self.tokenizer), "digest binary, n_tokens long")
        counted.dropDuplicates(["digest"]).write.mode("append").parquet(self.path)
        # Both sides are read from tables: with a sum beneath the join, a digest that very many rows have could not be split.
        return rows.join(freeze(self.stored(), "counts"), "digest", "left").select(
            "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
        )
