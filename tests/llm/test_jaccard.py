import random
import re

import numpy as np
import pytest
from conftest import plan
from dashloom.llm import jaccard
from dashloom.llm.jaccard import ngram_join, one_of_each
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, n_shingles string, node long, label int"


def grams(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [grams(t, width) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)), links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_whole_table(spark, sf, width, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(ngram_join(docs, width, percent)) == brute(rows, width, percent)


def test_edge_cases(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(400)}" for _ in range(200)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, "alone here"),
            (7, "É a b c"), (8, "é a b c"), (9, "a\x85b c d"), (9, "a\x85b c d"), (10, "x " * 5000), (10, "y z q")]
    for i in range(60):  # a dense group: near copies of one text, some pairs above and some below the limit
        words = list(base)
        for _ in range(i % 7):
            words[r.randrange(len(words))] = f"n{i}-{r.randrange(1000)}"
        rows.append((100 + i, " ".join(words)))
    rows.append((300, " ".join(f"v{i}" for i in range(150_000))))
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], DOCS)
    assert result(ngram_join(df, 3, 90)) == brute(rows, 3, 90)
    assert result(ngram_join(df, 5, 80)) == brute(rows, 5, 80)


def test_links_in_blocks(spark, monkeypatch):
    """Components cut into blocks, and bundles of small ones, give the links of all pairs."""
    monkeypatch.setattr(jaccard, "GRAMS", 700)
    monkeypatch.setattr(jaccard, "LEAST", 1)
    r = random.Random(8)
    rows = []
    for c in range(12):
        base = [f"c{c}w{i}" for i in range(60)]
        for _ in range([40, 2, 3, 1][c % 4]):
            words = list(base)
            words[r.randrange(60)] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:10])]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], DOCS)
    assert result(ngram_join(df, 3, 90)) == brute(rows, 3, 90)


def test_common_counts():
    r = np.random.default_rng(2)
    left, right = ([np.unique(r.integers(0, 5000, r.integers(0, 900))) for _ in range(n)] for n in (7, 9))
    assert (jaccard._common(left, right) == [[len(set(a) & set(b)) for b in right] for a in left]).all()


def test_hot_gram(spark):
    """Thousands of near copies: no window, and the session's batches are as before."""
    base = " ".join(f"w{i}" for i in range(80))
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " own"), F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = ngram_join(df, 3, 90)
    assert "Window" not in plan(found) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert found.agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first() == (3999, 3999, 0)


def test_hot_groups(spark):
    copies = [(i, "the same text in a third of all rows") for i in range(3000)]
    others = [(i, f"text number {i} stands alone with word {i * 7}") for i in range(3000, 6000)]
    df = spark.createDataFrame(copies + others, "doc_id long, text string")
    found = ngram_join(df, 3, 90)
    assert found.where("component_id = 0").count() == 3000
    assert found.where("component_id != doc_id").agg(F.max("doc_id")).first()[0] == 2999


def test_empty(spark):
    assert ngram_join(spark.createDataFrame([], DOCS), 3, 90).collect() == []


def test_one_of_each(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {d for d, n, first, _ in brute(rows, 5, 80) if n == 0 or d == first}
    kept = one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == {tuple(r) for r in docs.collect() if r["doc_id"] in want}
