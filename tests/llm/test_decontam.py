import random
import re

from dashloom.llm.decontam import find_items, without_items

ITEMS = "item_id long, text string, share double"


def grams(text, width=5):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower()) if w]
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, items, percent=80):
    sets = [(i, grams(t)) for i, t in items]
    out = []
    for d, text in docs:
        own = grams(text)
        out += [(d, i, len(s), len(s & own) / len(s)) for i, s in sets if s and 100 * len(s & own) >= percent * len(s)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.drop("row_key").collect()), key=str)


def test_whole_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    found = result(find_items(docs, items))
    assert found
    assert found == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])


def test_edge_cases(spark):
    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((1, 4, 5, 6, 12, 13, 20, 21, 36, 37, 100, 400))] + [(50, None), (51, ""), (52, "...")]
    long = text(60_000).split()
    docs = [(1, None), (2, ""), (3, items[1][1].upper()), (4, text(40))]
    for i, (_, t) in enumerate(items[2:12]):
        words = t.split()
        at = r.randrange(len(long))
        docs.append((10 + i, " ".join(long[at:] + ["("] + words + ["),"] + long[:at])))
        if len(words) > 60:
            words[len(words) // 2] = "changed"
            docs.append((30 + i, ", ".join(words)))
        docs.append((50 + i, text(30) + "\n" + t))
        docs.append((50 + i, text(30) + "\n" + t))
    docs.append((None, items[8][1]))
    d = spark.createDataFrame([(a, b, 0.5, 1) for a, b in docs], "doc_id long, text string, containment double, row_key int")
    i = spark.createDataFrame([(a, b, 1.0) for a, b in items], ITEMS)
    found = result(find_items(d.select("doc_id", "text"), i))
    assert found == brute(docs, items)
    flagged = {x[0] for x in found}
    kept = without_items(d, i)
    assert kept.columns == d.columns
    assert sorted((x[0] for x in kept.collect())) == sorted(x for x, _ in docs if x not in flagged)


def test_items_of_few_shingles(spark):
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    items = [(i, text(5 + i % 4 // 3)) for i in range(3000)] + [(3000, "a b c d e f g h i j k l")]
    docs = [(i, f"{text(30)} {t} {text(30)}") for i, t in items]
    docs.append((9000, f"a b c d e f g h {text(99)} e f g h i j k l"))  # all shingles, in two places
    found = result(find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t, 1.0) for i, t in items], ITEMS)))
    assert {x[:2] for x in found} == {(i, i) for i, _ in items} | {(9000, 3000)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert find_items(docs, items).collect() == []
    assert find_items(some, items).collect() == []
    assert without_items(some, items).count() == 1
