"""Short test items found inside long documents, by MinHash containment search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks, shingles, small

HASHES = 64
BLOCK = 8  # positions; the smallest size class, and the step of the windows
ITEMS_AT_ONCE = 5_000  # test items sent to the tasks at once; more are searched in further passes
_TABLE = 1 << 16

_ODD = np.random.default_rng(20240229).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The minimum of each hash function in each run, as 32-bit numbers (functions x runs)."""
    out = np.empty((HASHES, len(starts)), np.uint32)
    for i in range(HASHES):
        out[i] = np.minimum.reduceat(((hashes * _ODD[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def size_class(n: int) -> int:
    """The smallest power-of-two class, from BLOCK on, that holds an item of `n` shingles."""
    return max(BLOCK, 1 << (n - 1).bit_length())


class ItemIndex:
    """MinHash values of items, by size class, and the shingles themselves of items of the smallest
    class, a few of which are too small a part of a window for 64 values. Items of one other class are searched in windows of
    their class plus a block, so an item's share of a window is bounded from below: at least a
    third for items in the upper half of a class, whatever the length of the document."""

    def __init__(self, items: list[tuple[int, str | None]], width: int):
        self.sets: list[np.ndarray] = []
        self.ids: list[int] = []
        for item_id, text in items:
            raw = (text or "").lower().encode("utf-8", "surrogatepass")
            grams, _ = shingles([raw], width, marks=True)
            if len(grams):
                self.ids.append(item_id)
                self.sets.append(np.unique(grams))
        few = [i for i, s in enumerate(self.sets) if size_class(len(s)) == BLOCK]
        grams = np.concatenate([np.zeros(0, np.uint64), *(self.sets[i] for i in few)])
        order = np.argsort(grams, kind="stable")
        self.few = grams[order], np.repeat(np.array(few, np.int64), [len(self.sets[i]) for i in few])[order]
        self.classes = {}
        for size in sorted({size_class(len(s)) for s in self.sets} - {BLOCK}):
            own = np.array([i for i, s in enumerate(self.sets) if size_class(len(s)) == size])
            values = np.stack([_least(self.sets[i], np.array([0]))[:, 0] for i in own], axis=1)
            tables = np.zeros((HASHES, _TABLE), bool)
            for i in range(HASHES):
                tables[i, values[i] >> 16] = True
            self.classes[size] = (own, values, tables)

    def candidates(self, hashes: np.ndarray, where: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a MinHash value in some window, or a shingle of a small item."""
        found: set[tuple[int, int]] = set()
        grams, of = self.few
        lo, hi = (np.searchsorted(grams, hashes, side=s) for s in ("left", "right"))
        hit = np.flatnonzero(lo < hi)
        for t, a, b in np.unique(np.c_[where[hit], lo[hit], hi[hit]], axis=0).tolist():
            found.update((t, item) for item in of[a:b].tolist())
        if not len(hashes) or not self.classes:
            return found
        first = np.r_[0, np.flatnonzero(np.diff(where)) + 1]
        n = np.diff(np.r_[first, len(where)])
        blocks = -(-n // BLOCK)
        last = np.repeat(np.cumsum(blocks) - 1, blocks)
        k = np.arange(len(last)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        least = _least(hashes, np.repeat(first, blocks) + k * BLOCK)
        text = np.repeat(where[first], blocks)
        here, span = np.arange(len(last)), 1
        for size, (own, values, tables) in self.classes.items():
            while span < size // BLOCK:  # windows of twice the blocks, cut at the text's end
                least = np.minimum(least, least[:, np.minimum(here + span, last)])
                span *= 2
            window = np.minimum(least, least[:, np.minimum(here + 1, last)])
            for i in range(HASHES):
                hit = np.flatnonzero(tables[i][window[i] >> 16])
                if len(hit):
                    order = np.argsort(values[i], kind="stable")
                    ranked = values[i][order]
                    lo, hi = (np.searchsorted(ranked, window[i][hit], side=s) for s in ("left", "right"))
                    for w, a, b in zip(hit[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                        found.update((int(text[w]), int(own[order[j]])) for j in range(a, b))
        return found


def _search(index, width: int, percent: int) -> Callable:
    def run(batches):
        items: ItemIndex = index.value
        for batch in small(batches):
            texts = [t and t.lower() for t in batch.column("text").to_pylist()]
            rows, ids, share, n = [], [], [], []
            for first, raws in chunks(texts):
                hashes, where = shingles(raws, width, marks=True)
                borders = np.searchsorted(where, np.arange(len(raws) + 1))
                own: dict[int, np.ndarray] = {}
                for text, item in sorted(items.candidates(hashes, where)):
                    if text not in own:
                        own = {text: np.unique(hashes[borders[text] : borders[text + 1]])}
                    grams = items.sets[item]
                    at = np.minimum(np.searchsorted(own[text], grams), len(own[text]) - 1)
                    common = int((own[text][at] == grams).sum())
                    if common * 100 >= percent * len(grams):
                        rows.append(first + text)
                        ids.append(items.ids[item])
                        share.append(common / len(grams))
                        n.append(len(grams))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), batch.column("row_key").take(pa.array(rows, pa.int64())),
                 pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())],
                names=["doc_id", "row_key", "item_id", "n_shingles", "containment"],
            )
    return run


def find_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents that hold a test item: one row per document and item found.

    `docs` needs (doc_id, text), `items` (item_id, text); other columns are ignored. Words are
    lower-cased runs without white space and ASCII punctuation; an item is found in a document
    when `percent` per cent of its distinct shingles of `width` words are in the document.
    Returns doc_id, row_key (a hash of doc_id and text), item_id, n_shingles (of the item) and
    containment. Null and empty texts hold nothing; an item without words is not searched, and
    one of fewer than `width` words is found only in documents that consist of it. Repeated
    rows give repeated results; empty tables give none.

    Items are split by size, and each class is searched in windows of about its own size over
    the whole document, so a short item is a good part of a window even in a long document.
    Any common MinHash value of 64 makes a candidate, for items of at most BLOCK shingles any
    common shingle, which exact shingle sets then verify. No
    row of `docs` is shuffled. Items go to the tasks ITEMS_AT_ONCE at a time; a larger table
    takes a pass over the documents for each such block.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key long, item_id long, "
        "n_shingles long, containment double"
    )
    found, block = None, []

    def search(block):
        sent = spark.sparkContext.broadcast(ItemIndex(block, width))
        return texts.mapInArrow(_search(sent, width, percent), schema)

    for row in items.select(F.col("item_id").cast("long"), "text").distinct().toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS_AT_ONCE:
            found = search(block) if found is None else found.union(search(block))
            block = []
    if block or found is None:
        found = search(block) if found is None else found.union(search(block))
    return found


def without_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents in which no test item was found, with all their columns and repeated rows.

    Null and empty texts hold nothing and stay, also without a doc_id. Without items, or where no item has a
    word, all documents stay; an empty table gives an empty one.
    """
    key = F.xxhash64("doc_id", "text")
    found = find_items(docs, items, width, percent).select("row_key", F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, (key == found["row_key"]) & docs["doc_id"].eqNullSafe(found["__id"]), "left_anti")
