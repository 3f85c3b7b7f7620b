"""Toxicity by compression distance: windows compressed with a toxic and an ordinary dictionary."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from .fit import Logistic
from .words import small

SAMPLE = 16_000  # labelled documents used at most: those with the smallest hash of their id
TOXIC_BYTES, ORDINARY_BYTES = 8192, 65536
ROUNDS = 3  # times that the toxic windows are chosen anew
SHARE = 0.995  # of ordinary windows that a toxic one must be farther than
CALIBRATION = 5  # one part in so many of the sample calibrates, the others train
TOP = 4  # distances of a document that are looked at
_WORDS = 1 << 19  # windows remembered in one Python worker

# Both dictionaries end with this text and every window starts with it, so that a window is
# never stored raw; the end keeps the last word within reach of the match finder.
_FRAME = b"the window is compressed with what came before it:"
_END = bytes(range(8))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never looked at."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def windows(text: str | None) -> set[str]:
    """The windows of a whole text: its distinct lower-case words, whatever its label."""
    return set((text or "").lower().split())


def _window(word: str) -> bytes:
    return f" {word} ".encode("utf-8", "surrogatepass")


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=17, search_log=6, min_match=3, target_length=64,
        strategy=zstd.STRATEGY_BTLAZY2, write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    dictionary = zstd.ZstdCompressionDict(content + _FRAME, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(compression_params=params, dict_data=dictionary)


class Distance:
    """Bytes that a window takes more with the ordinary dictionary than with the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.known: dict[str, int] = {}

    def of(self, word: str) -> int:
        raw = _FRAME + _window(word) + _END
        return len(self.ordinary.compress(raw)) - len(self.toxic.compress(raw))

    def features(self, text: str | None) -> list[float]:
        """The largest and the mean distance of the text's windows, and how many it has."""
        words = windows(text)
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) > _WORDS:
                known.clear()
                new = list(words)
            for w in new:
                known[w] = self.of(w)
        far = sorted(map(known.__getitem__, words), reverse=True)
        return [*far[:TOP], *[0] * (TOP - len(far)), sum(far) / max(1, len(far)), float(np.log1p(len(words)))]


_READY: dict[int, Distance] = {}


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    calibrated: Logistic | None
    share: float  # of toxic documents, for a table without both labels

    def distance(self) -> Distance:
        key = zlib.crc32(self.toxic + self.ordinary)
        if key not in _READY:
            _READY.clear()
            _READY[key] = Distance(self.toxic, self.ordinary)
        return _READY[key]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.calibrated is None:
            return np.full(len(texts), self.share)
        d = self.distance()
        return self.calibrated.score(np.array([d.features(t) for t in texts], float).reshape(len(texts), TOP + 2))


def _count_windows(batches):
    """How many documents of each label have a window, by half."""
    counts: dict[tuple[int, str], list[int]] = {}
    for batch in small(batches):
        for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
            for w in windows(text):
                counts.setdefault((half, w), [0, 0])[label] += 1
        if len(counts) > _WORDS:  # merged by Spark anyway
            yield _counted(counts)
            counts = {}
    yield _counted(counts)


def _counted(counts: dict) -> pa.RecordBatch:
    halves, words = zip(*counts, strict=True) if counts else ((), ())
    ordinary, toxic = zip(*counts.values(), strict=True) if counts else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(halves, pa.int32()), pa.array(words, pa.string()), pa.array(toxic, pa.int64()), pa.array(ordinary, pa.int64())],
                                      names=["half", "word", "toxic", "ordinary"])


def _dictionary(counted: DataFrame, label: str, size: int) -> bytes:
    """The windows that most documents of a label have, as many as fit, the most frequent last, where they are cheapest to refer to."""
    # A window takes two bytes at least, so no more than size / 2 fit.
    found = counted.where(F.col(label) > 0).groupBy("word").agg(F.sum(label).alias("n")).orderBy(F.desc("n"), "word").limit(size // 2).collect()
    out, room = [], size
    for r in found:
        raw = _window(r["word"])
        if len(raw) > room:
            break
        out.append(raw)
        room -= len(raw)
    return b"".join(reversed(out))


def _distances(pairs: list[tuple[bytes, bytes]]):
    """Each window's distance by the dictionaries that the other half trained."""

    def run(batches):
        own = [Distance(*p) for p in pairs]
        for batch in batches:
            far = [own[1 - h].of(w) for h, w in zip(batch.column("half").to_pylist(), batch.column("word").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.int32())], names=[*batch.schema.names, "far"])
    return run


def _chosen(counted: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The windows that are toxic by distance: (half, word, toxic).

    At first all windows of toxic documents count. In each round the dictionaries of one
    half measure the windows of the other; of those in toxic documents the ones stay that are
    farther than SHARE of the windows of ordinary documents. No list of words takes part.
    """
    halves = [counted.where(F.col("half") == h) for h in (0, 1)]
    ordinary = [_dictionary(own, "ordinary", size[1]) for own in halves]
    kept = counted.where("toxic > 0").select("half", "word", "toxic")
    for _ in range(ROUNDS):
        pairs = [(_dictionary(kept.where(F.col("half") == h), "toxic", size[0]), ordinary[h]) for h in (0, 1)]
        far = freeze(counted.mapInArrow(_distances(pairs), "half int, word string, toxic long, ordinary long, far int"), "far")
        histogram = far.where("ordinary > 0").groupBy("half", "far").agg(F.sum("ordinary").alias("n")).collect()  # a row for each whole distance
        cuts = []
        for h in (0, 1):
            own = sorted((r["far"], r["n"]) for r in histogram if r["half"] == h)
            upto = np.cumsum([n for _, n in own])
            cuts.append(own[int(np.searchsorted(upto, SHARE * upto[-1]))][0] if own else 0)
        # Unlike enough to all that is ordinary, and to be paid for by the toxic dictionary.
        enough = F.col("far") > F.greatest(F.when(F.col("half") == 0, cuts[0]).otherwise(cuts[1]), F.lit(0))
        better = far.where((F.col("toxic") > 0) & enough).select("half", "word", "toxic")
        if better.isEmpty():
            break
        kept = better
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Dictionaries from most of the labelled sample, calibration from the rest.

    Labels of held-out documents, null labels and null ids are left out; of a doc_id with
    several labels the largest counts. All windows of the sample's whole texts are used, of
    both kinds alike. The training part has two halves by hash: the dictionaries of each tell which
    windows of the other are toxic, by distance alone (`_chosen`). What is chosen in both makes
    the toxic dictionary, the most frequent windows of the ordinary documents the other one.
    To the driver come the windows that fill a dictionary and the features of the part that calibrates.
    """
    known = (
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # At most `sample` rows of two numbers. Equal texts are in one part and one half.
    both = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["text", "toxic"])
    part = F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(CALIBRATION)).cast("int")
    half = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(2)).cast("int")
    both = freeze(both.select("text", "toxic", part.alias("part"), half.alias("half")), "labelled")
    shares = {r["toxic"]: r["n"] for r in both.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_ordinary = shares.get(1, 0), shares.get(0, 0)
    if not n_toxic or not n_ordinary:
        return Model(b"", b"", None, float(bool(n_toxic)))
    training = both.where("part > 0").select("text", "toxic", "half")
    counted = training.mapInArrow(_count_windows, "half int, word string, toxic long, ordinary long")
    counted = freeze(counted.groupBy("half", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "windows")
    toxic = _dictionary(_chosen(counted, (TOXIC_BYTES, ORDINARY_BYTES)), "toxic", TOXIC_BYTES)
    model = Model(toxic, _dictionary(counted, "ordinary", ORDINARY_BYTES), None, 0.0)

    def measure(batches):
        d = model.distance()
        for batch in small(batches):
            x = [d.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = both.where("part = 0").select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").orderBy("x", "toxic").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if len(rows) and 0 < y.mean() < 1:
        model.calibrated = Logistic.fit(np.array([r["x"] for r in rows]), y, penalty=0.1)
    else:
        model.share = float(n_toxic / (n_toxic + n_ordinary))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1) and predicted (0 or 1).

    `docs` needs (doc_id, text); other columns are ignored, and the id has no part in the
    score. Windows are the distinct lower-case words; a null text is an empty one, which has no
    window and the score of a text without distances. Repeated rows get the same score; an
    empty table gives an empty one. Without both labels to learn from, all scores are the
    share of toxic ones. No row is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small(batches):
            s = sent.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
