"""Lines that many documents share, found with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze, new_path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"


class LineRuns:
    """Line hashes with document counts, in runs sorted by hash.

    A run is a table bucketed and sorted by the hash's two halves, so runs of any age merge with each other
    without a shuffle; only the lines that are settled are shuffled, for the join with a batch. A batch adds a run to level 0; `fanout` runs of a level
    are compacted into one of the next level, so n batches leave about fanout * log(n) runs.
    Lines that have reached `settled` documents are known for good: each new batch
    anti-joins them and adds only its other lines.
    """

    def __init__(self, spark: SparkSession, settled: int, fanout: int = 4):
        self.spark, self.settled, self.fanout = spark, settled, fanout
        self.levels: list[list[str]] = []
        self.batches = 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        # What is written has been summed by h1 and h2, so a task's rows are in few buckets.
        (df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", new_path(self.spark, name)).format("parquet").saveAsTable(name))
        return name

    def _merged(self, names: list[str]) -> DataFrame | None:
        runs = [self.spark.table(n) for n in names]
        if not runs:
            return None
        out = runs[0]
        for r in runs[1:]:
            out = out.union(r)
        return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("first"))

    def counts(self) -> DataFrame | None:
        """(h1, h2, n_docs, first) of every line; first is the earliest (batch, document)."""
        return self._merged([n for level in self.levels for n in level])

    def frequent(self) -> DataFrame | None:
        known = self.counts()
        return known if known is None else known.where(F.col("n_docs") >= self.settled)

    def add(self, lines: DataFrame) -> None:
        """Add a batch: (h1, h2, key), a row for each line; a key's equal lines count once."""
        first = F.struct(F.lit(self.batches).alias("batch"), F.col("key"))
        own = lines.select("h1", "h2", "key").distinct().groupBy("h1", "h2").agg(
            F.count(F.lit(1)).alias("n_docs"), F.min(first).alias("first"))
        if (known := self.frequent()) is not None:
            own = own.join(known.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self.batches += 1
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(own))
        self._compact()

    def _compact(self) -> None:
        for i, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                run = self._write(self._merged(names))
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(run)
                self.levels[i] = []

    def close(self) -> None:
        """Forget the tables; their files stay until the application's folder is cleared."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                      copies_once: bool = False, batches: int = 4) -> DataFrame:
    """Documents without the lines that at least `min_docs` documents share.

    `docs` needs (doc_id, text) and may have any other columns, which stay. A line's key is the
    line without ASCII white space at both ends, A-Z as a-z; keys of fewer than `min_chars`
    code points are never dropped. With `keep_first` each such line stays in one document, the
    first of the earliest batch by a hash of the document, else it goes everywhere. With
    `copies_once` all documents of one text count once and are treated alike. A null or empty
    text is one empty line. Repeated rows (doc_id and text) are one document, and all of them stay. Adds kept
    (the text that is left), n_lines and n_dropped; a column of `docs` with such a name is replaced.

    Lines are cut once and written as hashes with their position. Batches go through `LineRuns`
    one by one. Line hashes join the frequent ones; the join is left to adaptive execution,
    which splits a line that holds a third of all rows. The text is shuffled once, to its positions.
    """
    spark = docs.sparkSession
    # Two hashes: with one, two of 10^10 documents would lose each other's lines.
    key = F.struct(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    clean = lambda x: F.translate(F.btrim(x, F.lit(_BLANK)), _UPPER, _LOWER)
    hashed = F.transform(
        _lines(F.col("text")),
        lambda x, i: F.struct(i.alias("at"), F.xxhash64(clean(x)).alias("h1"), F.xxhash64(F.lit(1), clean(x)).alias("h2"),
                              (F.char_length(clean(x)) >= min_chars).alias("long")),
    )
    owner = F.struct(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")) if copies_once else key
    cut = docs.select(key.alias("key"), owner.alias("owner"), F.explode(hashed).alias("l")).where("l.long")
    cut = cut.select("key", "owner", "l.at", "l.h1", "l.h2", F.pmod("owner.k1", F.lit(batches)).alias("batch"))
    cut = freeze(cut, "lines")
    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        runs.add(cut.where(F.col("batch") == b).select("h1", "h2", F.col("owner").alias("key")))
    frequent = freeze(runs.frequent().select("h1", "h2", F.col("first.key").alias("first_owner")), "frequent")
    runs.close()
    gone = cut.join(frequent, ["h1", "h2"])
    if keep_first:
        gone = gone.where("owner != first_owner")
    gone = gone.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("at"))

    # Positions become flags: for each dropped line, a 0 for every line kept before it, then a 1.
    # Line by line this is one pass, however many lines a document has.
    at = F.col("__gone.at")
    gaps = F.zip_with(at, F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))), lambda x, y: x - y - 1)
    flags = F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(F.repeat(F.lit("0"), g), F.lit("1"))), ""),
                     F.repeat(F.lit("0"), F.size("__lines") - F.element_at(at, -1) - 1))
    zipped = F.arrays_zip(F.col("__lines").alias("line"), F.split(flags, "").alias("flag"))
    kept = F.transform(F.filter(zipped, lambda z: z["flag"] == "0"), lambda z: z["line"])
    joined = docs.withColumn("__key", key).join(
        gone.select(F.col("key").alias("__key"), F.struct("at").alias("__gone")), "__key", "left"
    ).withColumn("__lines", _lines(F.col("text")))
    out = joined.withColumns({
        "kept": F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(F.size(at)).cast("long"),
    })
    return out.drop("__key", "__gone", "__lines")
