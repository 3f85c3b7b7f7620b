"""Nulls, blank and very long texts, repeated rows, empty tables and clashing columns, stage by stage."""

import corpus_pipeline as cp
import pytest
from dashloom.llm import decontam, packing, quality, sharding
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 24_000
PROSE = "A text of some length that says one thing after another and then it ends here. "
ROWS = [(1, None, "en", "s", 3), (2, "", None, None, None), (3, " \t\n ", "en", "s", 0), (None, "no id at all", "de", "s", 12), (4, LONG, "en", "s", len(LONG)),
        (5, PROSE, "en", "s", 80), (5, PROSE, "en", "s", 80), (6, PROSE + "More.", "en", None, 85), (7, "one", "", "", -1)]
KEPT_ALWAYS = {1, 2, 3}  # nothing in them to judge by lines, copies or items


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "an item that no document has in it anywhere at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        got, given = rows_of(kept), rows_of(docs)
        if name == "line_dedup":
            assert got == given  # no line is in ten texts
        elif name == "ngram_join":
            assert got == sorted([r for i, r in enumerate(given) if i == 0 or r != given[i - 1] or not (r[1] or "").strip()], key=str) or {5, 6} & {r[0] for r in got} == {5}
            assert sum(r[0] == 5 for r in got) == 1 and KEPT_ALWAYS <= {r[0] for r in got}
        elif name == "decontamination":
            assert got == given
        else:
            assert set(got) <= set(given)
            assert all(got.count(r) == given.count(r) for r in set(got))  # repeated rows stay or go together
    packed = cp.packing_stage(spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in ROWS}
    assert sum(r["length"] for r in packed if r["doc_id"] == 4) == 24_001 and all(r["length"] <= 2048 for r in packed)
    assert [r["length"] for r in packed if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]


def test_run_on_odd_rows(spark, folder):
    got = cp.run(spark, folder)
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pieces_that_fit_nowhere(spark):
    pieces = spark.createDataFrame([(1, None, "x"), (2, 0, "x"), (3, -5, "x"), (4, 11, "x"), (5, 10, "x"), (6, 4, "x"), (7, 4, "x"), (7, 4, "x")], "id long, length long, offset string")
    got = {(r["id"], r["sequence_id"] is None, r["offset"] is None) for r in packing.pack(pieces, window=10).collect()}
    assert got == {(i, i < 5, i < 5) for i in range(1, 8)}
    assert packing.pack(pieces.limit(0), window=10).count() == 0


def test_keep_good_and_without_items(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit("clash"), "row_key": F.lit(1), "item_id": F.lit(2)})
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    none = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet").limit(0))
    assert quality.keep_good(docs, none).count() == len(ROWS)
    items = spark.createDataFrame([(1, "A text of some length that says one thing after another")], "item_id long, text string")
    left = decontam.without_items(docs, items)
    assert left.columns == docs.columns and rows_of(left) == [r for r in rows_of(docs) if r[0] not in (5, 6)]
    assert rows_of(decontam.without_items(docs, items.limit(0))) == rows_of(docs)


def test_written_shards(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("shard", F.lit("clash"))
    sharding.write_shards(docs, "doc_id", [1.0] * 4, f"{tmp_path}/out", spread=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    plain = [c for c in docs.columns if c != "shard"]
    assert rows_of(back.select(*plain)) == rows_of(docs.select(*plain))
    want = docs.select("doc_id", sharding.shard_of(F.col("doc_id"), [1.0] * 4).alias("shard"))
    assert rows_of(back.select("doc_id", F.col("shard").cast("int"))) == rows_of(want)
    sharding.write_shards(docs.limit(0), "doc_id", [1.0], f"{tmp_path}/none")
    assert not list((tmp_path / "none").glob("**/*.parquet"))


def test_shard_winners_by_hand(spark):
    """Each key's draws worked out with the xxhash library, for equal and unequal weights."""
    import math

    import xxhash

    def winner(key, weights):
        seed = xxhash.xxh64((key if key is not None else "\0null").encode(), seed=42).intdigest()
        draws = [xxhash.xxh64(i.to_bytes(4, "little"), seed=seed).intdigest() >> 12 for i in range(len(weights))]
        return min((-math.log((d + 0.5) / (1 << 52)) / w, i) for i, (d, w) in enumerate(zip(draws, weights, strict=True)))[1]

    keys = [None, "", *map(str, range(500))]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for weights in ([1.0] * 16, [1.0] * 17, [0.5, 2.0, 7.0]):
        got = {r[0]: r[1] for r in df.select("k", sharding.shard_of(F.col("k"), weights).alias("s")).collect()}
        assert got == {k: winner(k, weights) for k in keys}
