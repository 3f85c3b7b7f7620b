"""Documents packed into token windows by minimum bin slack."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from .tokens import encoder
from .words import small

END = 1  # the id that ends every document
GROUP = 4096  # pieces packed together; each group leaves at most one window partly filled by lack of pieces


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 2048) -> DataFrame:
    """The ids of each document, ended by END, cut at multiples of `window`.

    Returns doc_id, start, length, ids (little-endian unsigned 32-bit numbers) and doc_tokens.
    A null text is an empty one: a single piece that holds END. Repeated rows give pieces each.
    """

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in small(batches):
            rows, starts, ids, totals = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = enc.ids(text) + end
                for at in range(0, len(raw), 4 * window):
                    rows.append(i)
                    starts.append(at // 4)
                    ids.append(raw[at : at + 4 * window])
                    totals.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                 pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long"
    )


def fill(counts: np.ndarray, window: int) -> np.ndarray:
    """How many pieces of each length to take so that their sum is as near `window` as can be.

    `counts[n]` pieces of length n are left. The longest goes first, as it fits worst; bits of
    an integer mark the sums that the others reach. A length with c pieces is added in parts
    of 1, 2, 4 and so on, so c pieces need about log2(c) shifts. The best sum is then traced
    back part by part.
    """
    taken = np.zeros_like(counts)
    longest = int(np.flatnonzero(counts)[-1])
    taken[longest] = 1
    room, mask = window - longest, (1 << (window - longest + 1)) - 1
    steps, reach = [], 1
    for n in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, part = min(int(counts[n]) - int(taken[n]), room // n), 1
        while left > 0:
            part = min(part, left)
            steps.append((n, part, reach))
            reach |= (reach << (n * part)) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    for n, part, before in reversed(steps):
        if not before >> best & 1:
            best -= n * part
            taken[n] += part
    return taken


def _pack(window: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("__id").to_numpy(), lengths))
        counts = np.bincount(lengths, minlength=window + 1)
        next_of = np.r_[0, np.cumsum(counts)]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        bins = 0
        while counts.any():
            taken = fill(counts, window)
            again = max(1, int((counts[taken > 0] // taken[taken > 0]).min()))  # the same filling, while it lasts
            counts -= taken * again
            for _ in range(again):
                at = 0
                for n in np.flatnonzero(taken)[::-1].tolist():
                    for row in order[next_of[n] : next_of[n] + taken[n]]:
                        sequence[row], offset[row] = bins, at
                        at += n
                    next_of[n] += taken[n]
                bins += 1
        group = int(key[0].as_py()) << 32
        return table.drop_columns(["__id", "__group"]).append_column("sequence_id", pa.array(sequence + group)).append_column("offset", pa.array(offset))
    return run


def pack(pieces: DataFrame, window: int = 2048, group: int = GROUP) -> DataFrame:
    """Put pieces (length of 1 to `window`, any other columns) into sequences of at most `window`.

    Adds sequence_id and offset, gapless from 0 within a sequence; columns of those names are
    replaced. A piece whose length is null, below 1 or above `window` fits nowhere and has nulls
    there. Pieces of equal length are dealt in the order of their numbers; repeated rows are pieces of
    their own. An empty table gives an empty one.

    The pieces are written once, each with a number; they are dealt to groups of about `group`
    pieces by a hash of it, so no text or length that many rows share makes a group larger.
    Within a group the histogram of the remaining lengths decides (see `fill`).
    """
    pieces = pieces.drop("sequence_id", "offset")
    pieces = freeze(pieces.withColumn("__id", F.monotonically_increasing_id()), "pieces")
    fits = F.coalesce(F.col("length").between(1, window), F.lit(False))
    nowhere = F.lit(None).cast("long")
    odd = pieces.where(~fits).drop("__id").withColumns({"sequence_id": nowhere, "offset": nowhere})
    pieces = pieces.where(fits)
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("__id"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "__id")
    return dealt.groupBy("__group").applyInArrow(_pack(window), f"{schema}, sequence_id long, offset long").union(odd)
