"""Near copies among embeddings, by an inverted multi-index."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from .components import components

CODES = 256  # codes of each half, at most; the grid has their square
IN_CELL = 16  # vectors a cell has on average, while the number of codes allows it
SAMPLE = 20_000  # vectors that the codebooks are fitted on, at most
PROBES = 1000  # vectors on which the number of cells to visit is measured, at most
MADE = 4  # neighbours made for each of them, at the least cosine
ROWS = 4096  # vectors of either side compared in one task at once


def unit(vectors: list) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None, :], 0)


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        own = _apart(x, codes).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


@dataclass
class MultiIndex:
    """Independent codebooks for the two halves; a cell is a pair of codes."""

    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, n: int) -> MultiIndex:
        """Codebooks for a table of n vectors, from a sample `x` of them."""
        k, half = max(1, min(CODES, math.isqrt(n // IN_CELL), len(x) // 4)), x.shape[1] // 2
        return cls(_codebook(x[:, :half], k, 1), _codebook(x[:, half:], k, 2))

    @property
    def cells_in_all(self) -> int:
        return len(self.first) * len(self.second)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _apart(x[:, :half], self.first), _apart(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of one cell for each vector in its order of cells."""
        out = []
        for at in range(0, len(x), 256):
            a, b = self.halves(x[at : at + 256])
            sums = (a[:, :, None] + b[:, None, :]).reshape(len(a), -1)
            own = np.take_along_axis(sums, cells[at : at + 256, None], 1)
            out.append((sums < own).sum(1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The `visits` nearest cells of each vector in the order of the multi-sequence.

        Both lists of codes are sorted by distance. The pair (i, j) of ranks comes after all
        (i', j') below it, so the first n pairs have (i + 1) * (j + 1) <= n; only those are
        added up, for all vectors at once.
        """
        n, (a, b) = self.visits, self.halves(x)
        oa, ob = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        i, j = np.array([(i, j) for i in range(min(n, a.shape[1])) for j in range(min(n // (i + 1), b.shape[1]))]).T
        sums = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
        best = sums.argpartition(n - 1, axis=1)[:, :n]
        return np.take_along_axis(oa, i[best], 1) * len(self.second) + np.take_along_axis(ob, j[best], 1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """Unit rows of a batch of vectors of one length."""
    return unit(batch.column("embedding").to_pylist())


def _made_ranks(index: MultiIndex, x: np.ndarray, least: float) -> np.ndarray:
    """Ranks at which neighbours made at the least cosine, in any direction, would be found."""
    rng = np.random.default_rng(3)
    found = []
    for _ in range(MADE):
        aside = rng.standard_normal(x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        long = np.sqrt((aside * aside).sum(1, keepdims=True))
        y = least * x + math.sqrt(max(0, 1 - least * least)) * aside / np.where(long > 0, long, 1)
        found.append(np.minimum(index.ranks(x, index.cells(y)), index.ranks(y, index.cells(x))))
    return np.concatenate(found)


def _real_ranks(index, probes, least: float):
    """How many of the probes' true neighbours are found at each rank; none is its own neighbour."""

    def run(batches):
        idx: MultiIndex = index.value
        own, p = probes.value
        homes, total = idx.cells(p), np.zeros(idx.cells_in_all, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, node = _vectors(batch), batch.column("node").to_numpy()
                for at in range(0, len(x), 1024):
                    i, j = np.nonzero(x[at : at + 1024] @ p.T >= least)
                    i, j = i[real := node[i + at] != own[j]] + at, j[real]
                    for s in range(0, len(i), 4096):
                        a, b = i[s : s + 4096], j[s : s + 4096]
                        rank = np.minimum(idx.ranks(p[b], idx.cells(x[a])), idx.ranks(x[a], homes[b]))
                        total += np.bincount(rank, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["rank", "n"])
    return run


def _needed(counts: np.ndarray, target: float) -> int:
    """Cells to visit so that `target` of what was counted by rank is found."""
    if not counts.sum():
        return 1
    return int(np.searchsorted(np.cumsum(counts), target * counts.sum() - 1e-9)) + 1


def _visits(classes: DataFrame, index: MultiIndex, probes: tuple, least: float, target: float) -> int:
    """Cells that find `target` of neighbours made at the least cosine and of the probes' true ones."""
    made = _needed(np.bincount(_made_ranks(index, probes[1], least), minlength=index.cells_in_all), target)
    sc = classes.sparkSession.sparkContext
    run = _real_ranks(sc.broadcast(index), sc.broadcast(probes), least)
    found = classes.select("node", "embedding").mapInArrow(run, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(index.cells_in_all, np.int64)
    for rank, n in found:  # at most a row for each cell
        counts[rank] = n
    return max(made, _needed(counts, target))


def _sizes(index):
    """Members of each first code and queries that visit it."""

    def run(batches):
        idx: MultiIndex = index.value
        own, seen = np.zeros(len(idx.first), np.int64), np.zeros(len(idx.first), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                x = _vectors(batch.slice(at, 512))
                own += np.bincount(idx.cells(x) // len(idx.second), minlength=len(own))
                seen += _visited(idx, x).any(2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(own), pa.array(seen)], names=["code", "own", "seen"])
    return run


def _visited(idx: MultiIndex, x: np.ndarray) -> np.ndarray:
    """For each vector, first code and second code: whether the vector visits the cell."""
    out = np.zeros((len(x), idx.cells_in_all), bool)
    np.put_along_axis(out, idx.nearest(x), True, axis=1)
    return out.reshape(len(x), len(idx.first), len(idx.second))


_ROW = "code int, m int, q int, query boolean, node long, copies long, home int, seen binary, vector binary"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _deal(index, parts):
    """Each vector once as a member of its first code and once as a query of each first code it visits."""

    def run(batches):
        idx: MultiIndex = index.value
        blocks = parts.value
        names = [c.split()[0] for c in _ROW.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _vectors(part)
                home, seen = idx.cells(x), np.packbits(_visited(idx, x), axis=2)
                out = []
                for i, (node, copies) in enumerate(zip(part.column("node").to_pylist(), part.column("copies").to_pylist(), strict=True)):
                    h, v = int(home[i]), x[i].tobytes()
                    own = h // len(idx.second)
                    m_of, q_of, _ = blocks[own]
                    out += [(own, node % m_of, q, False, node, copies, h, b"", v) for q in range(q_of)]
                    for c in np.flatnonzero(seen[i].any(1)).tolist():
                        m_of, q_of, some = blocks[c]
                        if some:
                            mask = seen[i, c].tobytes()
                            out += [(c, m, node % q_of, True, node, copies, h, mask, v) for m in range(m_of)]
                for s in range(0, len(out), 4000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[s : s + 4000], strict=True), _KINDS, strict=True)], names=names)
    return run


def _compare(index, least: float):
    """Links between a block of queries and a block of members of a first code.

    A query meets the members of the cells it visits. A pair counts for the query, and for the
    member too unless the member visits the query's own cell, where it is found once more from
    the other side. Sums and one label for each vector are given out, never pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        idx: MultiIndex = index.value
        table = table.combine_chunks()
        is_query = table.column("query").to_numpy(zero_copy_only=False)
        node, copies, home = (table.column(c).to_numpy() for c in ("node", "copies", "home"))
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(node), -1)
        qs, ms = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        links, root, touched = np.zeros(len(node), np.int64), np.arange(len(node)), np.zeros(len(node), bool)
        if len(qs) and len(ms):
            seen = np.frombuffer(b"".join(table.column("seen").to_pylist()), np.uint8).reshape(len(qs), -1)
            second = home[ms] % len(idx.second)
            for code in np.unique(second).tolist():
                own = ms[second == code]
                asks = qs[(seen[:, code // 8] >> (7 - code % 8) & 1).astype(bool)]
                for at in range(0, len(asks), 512):
                    a, b = np.nonzero(x[asks[at : at + 512]] @ x[own].T >= least)
                    a, b = asks[at : at + 512][a], own[b]
                    a, b = a[other := node[a] != node[b]], b[other]
                    if not len(a):
                        continue
                    np.add.at(links, a, copies[b])
                    met, place = np.unique(b, return_inverse=True)
                    back = np.concatenate([_visited(idx, x[met[s : s + 512]]).reshape(-1, idx.cells_in_all) for s in range(0, len(met), 512)])
                    once = ~back[place, home[a]]
                    np.add.at(links, b[once], copies[a[once]])
                    touched[a] = touched[b] = True
                    root = _merge(root, a, b)
        at = np.flatnonzero(touched)
        low = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(low, root[at], node[at])
        return pa.table({"node": node[at], "n": links[at], "label": low[root[at]]})
    return run


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots once each a and b are joined; a root is the smallest of its set."""
    while (root[a] != root[b]).any():
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _fitted(classes: DataFrame, n: int, least: float, target: float) -> MultiIndex:
    """The index of n vectors of one length, with the number of cells that a search visits."""
    taken = classes.orderBy(F.xxhash64("d1"), "d2").limit(SAMPLE).select("node", "embedding").collect()
    x = unit([r[1] for r in taken])
    index = MultiIndex.fit(x, n)
    probes = np.array([r[0] for r in taken[:PROBES]], np.int64), x[:PROBES]
    index.visits = min(index.cells_in_all, _visits(classes, index, probes, least, target))
    return index


def _links(classes: DataFrame, least: float, target: float) -> DataFrame:
    """node, n and label: parts of each vector's number of links, and nodes it is connected with."""
    size, found = F.size("embedding"), []
    lengths = [tuple(r) for r in classes.groupBy(size).count().collect()]  # a row for each length of a vector
    for length, n in sorted(lengths):
        own = classes.where(size == length)
        found.append(_indexed(own, _fitted(own, n, least, target), least))
    return reduce(DataFrame.union, found)


def _indexed(classes: DataFrame, index: MultiIndex, least: float) -> DataFrame:
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(index)
    sizes = classes.select("embedding").mapInArrow(_sizes(sent), "code long, own long, seen long").groupBy("code").agg(
        F.sum("own").alias("own"), F.sum("seen").alias("seen")).collect()  # a row for each first code
    blocks = {r["code"]: (-(-r["own"] // ROWS) or 1, -(-r["seen"] // ROWS) or 1, r["own"]) for r in sizes}
    dealt = classes.select("node", "copies", "embedding").mapInArrow(_deal(sent, spark.sparkContext.broadcast(blocks)), _ROW)
    return freeze(dealt.groupBy("code", "m", "q").applyInArrow(_compare(sent, least), "node long, n long, label long"), "links")


def near_copies(vectors: DataFrame, least: float = 0.9, target: float = 0.99) -> DataFrame:
    """Links between vectors of cosine `least` or more: a row for each vector.

    `vectors` needs (vec_id, embedding); other columns are ignored. Returns vec_id, n_links
    (vectors linked directly), component_id (the smallest vec_id reachable, itself included) and
    kept (vec_id = component_id). Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, and those of different lengths not with each other. Each row is a vector of its own,
    repeated ones too; a row without vec_id is linked but names no component unless all lack it.
    An empty table gives an empty one.

    Equal vectors are one with a number of copies, and every link is verified in double precision.
    For each length, codebooks of both halves are fitted on at most SAMPLE vectors and all vectors
    are indexed, however few or many. A search takes cells in the order of the multi-sequence until `target`
    of the neighbours should be found. How many cells that takes is measured on PROBES vectors: with MADE
    neighbours of each, made at exactly the least cosine, where they are farthest, in directions of
    all kinds, and with their true neighbours among all vectors; the larger number holds. Where data have no
    structure, that can be all cells, and every pair is compared.
    A pair is found if either side visits the other's cell. First codes of many vectors or visitors are
    compared block by block, each two blocks in a task of their own.
    """
    v = F.col("embedding")
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = freeze(
        rows.select(
            "vec_id", F.when(F.coalesce(usable, F.lit(False)), v).alias("embedding"), F.monotonically_increasing_id().alias("node")
        ).withColumns({"d1": F.xxhash64("embedding"), "d2": F.xxhash64(F.lit(1), "embedding")}), "vectors",
    )
    sound = rows.where("embedding is not null")
    if sound.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = freeze(
        sound.groupBy("d1", "d2").agg(F.min("node").alias("node"), F.min("vec_id").alias("vec_id"),
                                      F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies")), "classes",
    )
    compared = _links(classes, least, target)
    labels = components(compared.select(F.col("node").alias("a"), F.col("label").alias("b")))
    linked = compared.groupBy("node").agg(F.sum("n").alias("n"))
    named = (
        classes.select("d1", "d2", "node", "vec_id", "copies").join(linked, "node", "left").join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    named = freeze(named, "named")
    smallest = named.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    named = named.join(smallest, "label").select(
        F.col("d1"), F.col("d2"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = F.coalesce("component_id", "vec_id")
    return rows.join(named, ["d1", "d2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
