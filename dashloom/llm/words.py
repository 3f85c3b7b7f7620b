"""Words and shingles of whole texts, hashed with numpy inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SPACE = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 18  # bytes of text hashed at once; longer texts are a chunk of their own
BATCH = 1000  # rows sent to a Python task at once

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result depends on every bit of `x`."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _lowered() -> np.ndarray:
    table = _BYTE.copy()
    table[65:91] = _BYTE[97:123]
    return table


_LOWER = _lowered()
_SPACES = np.zeros(256, bool)
_SPACES[list(SPACE)] = True
#: Everything in ASCII that is neither a letter nor a digit.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class _Powers:
    """Powers of the base and of its inverse, as many as the longest chunk needed."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 1024)
            cls.up = np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, _BASE)])
            cls.down = np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, _INVERSE)])
        return cls.up[:n], cls.down[:n]


def few_at_once(spark: SparkSession) -> None:
    """From now on at most BATCH rows go to a Python task at once; a smaller setting stays.

    Both the JVM and Python hold a whole batch outside the heap; Spark's default of 10,000
    rows is a lot of text.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


@contextmanager
def smaller_batches(spark: SparkSession) -> Iterator[None]:
    """At most BATCH rows at once for what is written inside; then the session's setting is back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    few_at_once(spark)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few texts are held as Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 in runs of about `CHUNK` bytes, each with its first index."""
    run: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if run and size + len(raw) > CHUNK:
            yield first, run
            run, first, size = [], i, 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def word_hashes(raws: list[bytes], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and the text it is in; A-Z counts as a-z.

    Words are runs without white space or, with `marks`, without ASCII punctuation either.
    """
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    gap = (_MARKS if marks else _SPACES)[data]
    edge = np.diff(np.r_[True, gap].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _Powers.of(len(data))
    sums = np.r_[_U(0), np.cumsum(_LOWER[data] * up)]
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    borders = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.searchsorted(borders, start, side="right")


def _salts(n: int) -> np.ndarray:
    return np.arange(1, n + 1, dtype=np.uint64) * _BASE


def shingles(raws: list[bytes], width: int, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of `width` words, in text order, and the text it is in.

    A text with fewer words has its whole sequence as one; without words it has none.
    """
    words, of = word_hashes(raws, marks)
    n = np.bincount(of, minlength=len(raws))
    joined = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k, salt in enumerate(_salts(width)):
        joined += mix(words[k : k + len(joined)] + salt)
    inside = of[: len(joined)] == of[width - 1 :][: len(joined)]
    hashes, where = mix(joined[inside]), of[: len(joined)][inside]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        first = np.r_[0, np.cumsum(n)]
        whole = [
            mix(mix(words[first[i] : first[i + 1]] + _salts(n[i])).sum(keepdims=True) + _U(n[i]))
            for i in short
        ]
        hashes, where = np.r_[hashes, np.concatenate(whole)], np.r_[where, short]
        order = np.argsort(where, kind="stable")
        hashes, where = hashes[order], where[order]
    return hashes, where


def shingle_sets(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The index of each text with its distinct shingle hashes in ascending order."""
    for first, raws in chunks(texts):
        hashes, where = shingles(raws, width)
        borders = np.searchsorted(where, np.arange(len(raws) + 1))
        for i in range(len(raws)):
            yield first + i, np.unique(hashes[borders[i] : borders[i + 1]])
