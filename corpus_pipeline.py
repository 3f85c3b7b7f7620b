"""A training corpus from raw documents: rejected, deduplicated, decontaminated and packed.

Each stage is a function (spark, docs, sf_dir) over all that its predecessor kept; of an empty
table every stage makes an empty one. What it
returns is written as Parquet and read again as the next one's documents; a lost executor
costs part of one stage. All but the last return the columns of `documents`. Stages with Python
tasks lower the session's Arrow batches to `words.BATCH` rows, as what they return is run later; `run` puts that back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dashloom.llm import decontam, jaccard, line_dedup, packing, quality
from dashloom.llm.queries import tokenizer
from dashloom.llm.registry import table
from dashloom.llm.words import few_at_once, smaller_batches
from dashloom.session import new_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers score below a half go.

    Null texts and metadata are scored like others, repeated rows alike. Without labels of both
    kinds no document is told from another: all stay if the known ones are good or none is known.
    """
    few_at_once(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten different texts share stay in one of them; no document goes.

    A null text stays null and an empty one empty; repeated texts count once and are treated alike.
    """
    left = line_dedup.drop_shared_lines(docs, min_docs=10, keep_first=True, copies_once=True)
    changed = F.col("n_dropped") > 0
    left = left.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    left = left.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Documents without words are near no other and all stay; of repeated rows one stays.
    """
    few_at_once(spark)
    return jaccard.one_of_each(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts hold none; an empty benchmark leaves all.
    """
    few_at_once(spark)
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"), width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, packed into sequences of at most 2048.

    A null or empty text is one piece, its end token; a text of any length is cut into pieces.
    """
    few_at_once(spark)
    pieces = packing.token_pieces(docs, tokenizer("word_bpe_49k.json"), window=2048)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), window=2048)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL: classifiers, tokenizers and packing are in it. Tests hold it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The session's size of Arrow batches is afterwards as it was."""
    docs = table(spark, sf_dir, "documents")
    with smaller_batches(spark):
        for name, stage in STAGES:
            path = new_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
