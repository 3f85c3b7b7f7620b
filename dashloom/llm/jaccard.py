"""Similarity join on word n-grams: prefix filtering with the rarest n-grams first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from .components import components
from .words import mix, shingle_sets, small, smaller_batches

#: Counters of the n-gram frequencies. Their number is fixed, so they may be sent to all tasks;
#: they only order n-grams, and any order gives the same pairs.
COUNTERS = 1 << 20
PARTS = 256
MARKS = 1 << 22  # bits that tell tasks which rows are worth sending to a join; a fixed number
GRAMS = 1 << 20  # n-grams of the sets that are compared at once, of either side
LEAST = 512  # as many n-grams a set counts as, at least: bounds the number of sets at once
_OTHER = np.uint64(0xD1B54A32D192ED03)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits for the set, as two numbers."""
    n = np.uint64(len(hashes))
    return tuple(int(mix(mix(x).sum(keepdims=True) + n).view(np.int64)[0]) for x in (hashes, hashes ^ _OTHER))


def _texts(batches: Iterator[pa.RecordBatch], width: int):
    for batch in small(batches):
        yield batch, shingle_sets(batch.column("text").to_pylist(), width)


def _counters(width: int) -> Callable:
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, sets in _texts(batches, width):
            found = [s % np.uint64(COUNTERS) for _, s in sets]
            if found:
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["counter", "n"])
    return run


def _describe(width: int, percent: int, counts) -> Callable:
    """Size, digest, part sizes and prefix of each text's set."""

    def run(batches):
        often = counts.value
        for batch, sets in _texts(batches, width):
            sizes, first, second, parts, prefixes = [], [], [], [], []
            for _, s in sets:
                one, two = _digest(s)
                sizes.append(len(s))
                first.append(one)
                second.append(two)
                sizes_of = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PARTS)
                parts.append(np.minimum(sizes_of, 255).astype(np.uint8).tobytes())
                # Two sets with this share of common n-grams meet in their first n - need + 1.
                k = len(s) + 1 - -(-len(s) * percent // 100) if len(s) else 0
                rarest = np.lexsort((s, often[(s % np.uint64(COUNTERS)).astype(np.int64)]))[:k]
                prefixes.append(s[rarest].view(np.int64))
            columns = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            columns += [pa.array(x, pa.int64()) for x in (sizes, first, second)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(parts, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n", "d1", "d2", "parts", "prefix"],
            )
    return run


def _alike(percent: int) -> Callable:
    """Suffix filter: sets are cut at fixed borders; parts of different sizes bound the overlap."""

    def run(batches):
        for batch in small(batches, 2000):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for c in ("parts_a", "parts_b"))
            both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            most = (both - np.abs(a - b).sum(axis=1)) // 2
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(most * (100 + percent) >= percent * both))
    return run


def _marked(marks) -> Callable:
    """Rows whose key has its bit set: all that are needed, and few others."""

    def run(batches):
        bits = marks.value
        for batch in batches:
            at = batch.column("k1").to_numpy().view(np.uint64) % np.uint64(MARKS)
            yield batch.filter(pa.array((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))
    return run


def _sets(width: int) -> Callable:
    def run(batches):
        for batch, sets in _texts(batches, width):
            own, nodes = [s.view(np.int64) for _, s in sets], batch.column("node")
            for at in range(0, len(own), 100):
                yield pa.RecordBatch.from_arrays(
                    [nodes.slice(at, 100), pa.array(own[at : at + 100], pa.list_(pa.int64()))], names=["node", "grams"]
                )
    return run


def _possible(percent: int):
    """Length and positional filter for two postings (n, at) and (n2, at2) of one n-gram."""
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return (small * 100 >= large * percent) & (most * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    return joined.where(_possible(percent)).select(
        F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")
    ).distinct()


def _as_second(postings: DataFrame) -> DataFrame:
    return postings.select("gram", *(F.col(c).alias(f"{c}2") for c in postings.columns if c != "gram"))


class _Verifier:
    """Which pairs of nodes truly reach the share; each text needed is read and hashed once more."""

    def __init__(self, keyed: DataFrame, classes: DataFrame, width: int, percent: int):
        self.keyed, self.classes, self.width, self.percent = keyed, classes, width, percent
        self.sets: DataFrame | None = None

    def _texts_of(self, nodes: DataFrame) -> DataFrame:
        """One text for each node. Marks keep rows that are not needed out of the shuffle."""
        rows = freeze(self.classes.join(nodes, "node", "left_semi").select("node", "k1", "k2"), "rows")
        at = F.pmod("k1", F.lit(MARKS))
        # k1 is signed, MARKS a power of two: the remainder is that of its unsigned bits.
        words = rows.groupBy(F.shiftright(at, 6).alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(k1, {MARKS}) % 64 as int))")).alias("bits"))
        bits = np.zeros(MARKS // 64, np.uint64)
        found = words.toArrow()  # MARKS / 64 rows at most
        bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        sent = self.keyed.sparkSession.sparkContext.broadcast(bits)
        texts = self.keyed.select("k1", "k2", "text").mapInArrow(_marked(sent), "k1 long, k2 long, text string")
        return texts.join(rows, ["k1", "k2"]).select("node", "text")

    def links(self, pairs: DataFrame) -> DataFrame:
        p, sig = self.percent, self.classes.select("node", "n", "parts")
        side = lambda c: sig.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parts").alias(f"parts_{c}"))
        pairs = freeze(
            pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "parts_a", "parts_b")
            .mapInArrow(_alike(p), "a long, b long, n_a long, n_b long"), "pairs",
        )
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        sets = freeze(self._texts_of(nodes).mapInArrow(_sets(self.width), "node long, grams array<long>").dropDuplicates(["node"]), "sets")
        self.sets = sets if self.sets is None else self.sets.union(sets)
        side = lambda c: self.sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}"))
        same = F.size(F.array_intersect("grams_a", "grams_b"))
        return freeze(
            pairs.join(side("a"), "a").join(side("b"), "b")
            .where(same * (100 + p) >= p * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "links",
        )


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common n-grams of each set of one side with each of the other."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, gram, often = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row, gram = row[often[gram] > 1], gram[often[gram] > 1]
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    place = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1 if len(gram) else gram
    total, wide = np.zeros((len(left), len(right)), np.float32), 2048
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, wide):
        here = slice(*np.searchsorted(place, [first, first + wide]))
        own, at = row[here], place[here] - first
        sides = []
        for low, n in ((0, len(left)), (len(left), len(right))):
            side = np.zeros((n, wide), np.float32)
            inside = (own >= low) & (own < low + n)
            side[own[inside] - low, at[inside]] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total


def _link_counts(percent: int) -> Callable:
    """Links of each set, weighted by copies, with those of its component in the same group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, label, copies, n = (table.column(c).to_numpy() for c in ("node", "label", "copies", "n"))
        second = table.column("second").to_numpy(zero_copy_only=False)
        grams = table.column("grams").combine_chunks()
        flat, ends = grams.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(grams.value_lengths().to_numpy(zero_copy_only=False))]
        links = np.zeros(len(node), np.int64)
        order = np.argsort(label, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            a, b = rows[~second[rows]], rows[second[rows]]
            apart = len(b) > 0 or table.column("i")[0].as_py() != table.column("j")[0].as_py()
            if not apart:
                b = a
            if not len(a) or not len(b):
                continue
            sets = [[flat[ends[r] : ends[r + 1]] for r in side] for side in (a, b)]
            linked = _common(*sets) * (100 + percent) >= percent * (n[a][:, None] + n[b][None, :])
            if not apart:
                np.fill_diagonal(linked, False)
            links[a] += linked @ copies[b]
            if apart:
                links[b] += linked.T @ copies[a]
        return pa.table({"node": node, "links": links})
    return run


def _counted(classes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, links): documents with another set that links with the node's, every pair of a component compared once.

    Small components share groups of about GRAMS n-grams; a large one is cut into blocks of that
    size by hash, and each two of its blocks are a group. No pair leaves a task.
    """
    own = classes.select("node", "n", "copies").join(labels, "node")
    weight = F.greatest("n", F.lit(LEAST))
    sizes = freeze(own.groupBy("label").agg(F.sum(weight).alias("weight")), "sizes")
    small_ones = sizes.where(F.col("weight") <= GRAMS).agg(F.sum("weight")).first()[0] or 0
    bundles, large = -(-small_ones // GRAMS) or 1, F.col("weight") > GRAMS
    blocks = F.when(large, F.ceil(F.col("weight") / GRAMS)).otherwise(1)
    placed = own.join(sizes, "label").withColumns({"blocks": blocks, "group": F.when(large, F.col("label")).otherwise(-1 - F.pmod(F.xxhash64("label"), F.lit(bundles)))})
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                           (F.col("block") > F.col("other")).alias("second"), "label", "node", "n", "copies")
    counted = placed.join(sets, "node").groupBy("group", "i", "j").applyInArrow(_link_counts(percent), "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def _grouped(docs: DataFrame, width: int, percent: int, count: bool = True) -> DataFrame:
    """Each row's doc_id, key and n, with the label, smallest id, copies and links of its set."""
    spark = docs.sparkSession
    # Two hashes: with one, two of 10^10 rows would be taken for each other.
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    # One set of counters a task: no more tasks than a few rounds of the cluster, however many files there are.
    few = docs.select("text").coalesce(8 * spark.sparkContext.defaultParallelism)
    counted = few.mapInArrow(_counters(width), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, np.int64)
    found = counted.toArrow()  # COUNTERS rows at most
    counts[found["counter"].to_numpy()] = found["n"].to_numpy()
    sent = spark.sparkContext.broadcast(counts)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n long, d1 long, d2 long, parts binary, prefix array<long>"
    members = freeze(keyed.mapInArrow(_describe(width, percent, sent), schema), "members")
    classes = members.where("n > 0").groupBy("d1", "d2").agg(
        F.first("n").alias("n"), F.first("parts").alias("parts"), F.first("prefix").alias("prefix"), F.min(F.struct("k1", "k2")).alias("key"),
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # Numbered as they are written: a node is one set, not a digest of it.
    classes = freeze(classes.select(F.monotonically_increasing_id().alias("node"), "*", "key.*").drop("key"), "classes")

    postings = classes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "gram"))
    # The set in which an n-gram comes first has the fewest rarer ones: in a group of near
    # copies it is the most central, and most others link to it directly.
    heads = postings.groupBy("gram").agg(F.min(F.struct("at", "node", "n")).alias("pivot"), F.min("node").alias("least"), F.max("node").alias("last"))
    heads = freeze(heads.where("least != last").select("gram", F.col("pivot.node").alias("node2"), F.col("pivot.n").alias("n2"), F.col("pivot.at").alias("at2")), "heads")
    # Both sides are read from tables, so an n-gram with many postings is split over tasks.
    kept = freeze(postings.join(heads, "gram"), "postings")
    verifier = _Verifier(keyed, classes, width, percent)

    tried = freeze(_pairs(kept.where("node != node2"), percent), "pairs")
    links = verifier.links(tried)
    labels = components(links)

    named = kept.drop("node2", "n2", "at2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = freeze(named, "postings")
    mixed = named.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    named = freeze(named.join(mixed.select("gram"), "gram", "left_semi"), "mixed")
    rest = named.join(_as_second(named), "gram").where("label != label2 and node < node2")
    rest = _pairs(rest, percent).join(tried, ["a", "b"], "left_anti")
    links = links.union(verifier.links(rest))
    labels = components(links)

    named = classes.select("d1", "d2", "node", "first_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if count:
        named = named.join(_counted(classes, labels, verifier.sets, percent), "node", "left")
    else:
        named = named.withColumn("links", F.lit(None).cast("long"))
    named = freeze(named, "named")
    least = named.groupBy("label").agg(F.min("first_id").alias("least_id"))
    named = freeze(named.join(least, "label").select(
        "d1", "d2", "label", "least_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "groups")
    return members.select("doc_id", "k1", "k2", "n", "d1", "d2").join(named, ["d1", "d2"], "left")


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by shared word n-grams, one row per document.

    `docs` needs (doc_id, text); other columns are ignored. Words are runs without ASCII white
    space, A-Z as a-z; a set holds the distinct runs of `width` words, or the whole sequence of
    a shorter text. Documents link when 100 * common >= `percent` * united n-grams.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself
    included), n_copies (documents with the same set) and n_links (other documents linked directly, copies included).
    Null or empty texts and texts of white space have no n-grams, link with nothing and are their own component. A null doc_id
    keeps its row; it takes part in links but never names a component unless all are null.
    Repeated rows are copies of each other. An empty table gives an empty table.

    Equal sets, known by 128 bits, are one node from the first step on. N-grams are ordered by how often they occur
    in the whole table (rarest first); only a set's prefix is shuffled. Length and positional
    filters drop pairs inside the join, part sizes drop more, and what remains is verified.
    Pairs are tried in two steps: each node with one pivot of every prefix n-gram it has, then,
    for n-grams whose nodes are not yet in one component, all pairs between components. The
    second step completes the components, and dense groups need few pairs in it. Links are then
    counted inside each component, block by block in tasks, where every pair is compared once:
    work with the square of a component's distinct sets, but no pair is ever a row.
    """
    with smaller_batches(docs.sparkSession):
        found = _grouped(docs, width, percent)
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least_id", "doc_id").alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of `ngram_join`, with all columns of `docs`.

    The one with the smallest doc_id stays, one row of it if the row is repeated. Documents
    without words are in no group and all stay. An empty table gives an empty one.
    """
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k1"), F.col("k2"))).alias("first")
    with smaller_batches(docs.sparkSession):
        found = _grouped(docs, width, percent, count=False)
    kept = found.where("n > 0").groupBy("label").agg(first).select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2"))
    # Repeated rows are dropped before the join, so that none of them meet in a task.
    rows = docs.where(wordy).withColumns({"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64(F.lit(1), "doc_id", "text")})
    rows = rows.dropDuplicates(["__k1", "__k2"])
    return rows.join(kept, ["__k1", "__k2"], "left_semi").drop("__k1", "__k2").select(*docs.columns).union(docs.where(~wordy))
