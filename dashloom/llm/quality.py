"""Quality by co-training: a classifier of the text and one of the metadata teach each other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import Logistic
from .words import chunks, small, word_hashes

LABELLED = 10_000  # labelled documents used at most: those with the smallest hash of their id
UNLABELLED = 10_000  # further documents for pseudo-labels at most, chosen the same way
ROUNDS = 5
PER_ROUND = 500  # pseudo-labels that one classifier gives the other in a round, at most
BUCKETS = 64

_KINDS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t",
          "line": "\n", "stop": ".,;:!?'\"()-"}


def _kinds() -> np.ndarray:
    table = np.full(256, len(_KINDS))  # other ASCII marks
    for i, chars in enumerate(_KINDS.values()):
        table[[ord(c) for c in chars]] = i
    table[128:] = len(_KINDS) + 1
    return table


_KIND = _kinds()
_N_KINDS = len(_KINDS) + 2


def text_features(texts: list[str | None]) -> np.ndarray:
    """What the text itself shows: kinds of characters, words, repetition, lines, hashed words."""
    out = np.zeros((len(texts), _N_KINDS + 7 + BUCKETS))
    for first, raws in chunks(texts):
        words, of = word_hashes(raws)
        borders = np.searchsorted(of, np.arange(len(raws) + 1))
        for i, raw in enumerate(raws):
            if not raw:
                continue
            kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=_N_KINDS)
            own = words[borders[i] : borders[i + 1]]
            n, lines = max(len(own), 1), raw.count(b"\n") + 1
            _, counts = np.unique(own, return_counts=True)
            out[first + i] = np.r_[
                kinds / len(raw), np.log1p(len(own)), len(raw) / n, len(counts) / n, (counts.max() if len(counts) else 0) / n,
                (own[1:] == own[:-1]).sum() / n, np.log1p(lines), np.log1p(n / lines),
                np.bincount((own % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) / n,
            ]
    return out


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """What the page's record shows: hashed language and source, and the recorded length."""
    from zlib import crc32

    out = np.zeros((len(lang), 8 + 32 + 3))
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, crc32(str(a).encode()) % 8] = 1
        out[i, 8 + crc32(str(b).encode()) % 32] = 1
        size = np.log1p(max(n, 0)) if n is not None else 0
        out[i, 40:] = size, size * size, n is None
    return out


@dataclass
class Model:
    text: Logistic | None
    meta: Logistic | None
    combined: Logistic | None
    share: float  # of good documents; the score of all where one label is all there is
    given: tuple = ((0, 0.0), (0, 0.0))  # labels that the text and the metadata view gave, and their weight

    def scores(self, x_text: np.ndarray, x_meta: np.ndarray) -> np.ndarray:
        """Columns: score of the text view, of the metadata view, and of both."""
        if self.combined is None:
            return np.full((len(x_text), 3), self.share)
        margins = np.c_[self.text.margin(x_text), self.meta.margin(x_meta)]
        return np.c_[self.text.score(x_text), self.meta.score(x_meta), self.combined.score(margins)]


def _calibrated(model: Logistic, x: np.ndarray, y: np.ndarray) -> Logistic:
    """How sure a view may be: its margins against labels that it was not fitted on."""
    return Logistic.fit(model.margin(x)[:, None], y)


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Model:
    """Fit both views on two thirds of the labelled rows, exchange pseudo-labels, calibrate on the rest.

    In each round a view labels the rows of the pool it is surest of, in the ratio of the
    classes, for the other view. How much such a label counts is what the view knows beyond the share of its class:
    0 for a score that, calibrated on the held-back rows, is no better than the share, 1 for certainty. So both views give, and one that knows
    little does little harm. `given` counts the labels with a weight that each view gave, and the sum of the weights.
    A view whose margins do not separate the held-back rows is given no weight by the calibration.
    """
    if not len(y) or not 0 < y.mean() < 1:
        return Model(None, None, None, float(y.mean()) if len(y) else 1.0)
    back = np.arange(len(y)) % 3 == 2
    if not 0 < y[back].mean() < 1 or not 0 < y[~back].mean() < 1:
        back[:] = False
    rest = back if back.any() else ~back
    fit_x, fit_y = [v[~back] for v in views], [y[~back], y[~back]]
    weights = [np.ones((~back).sum()) for _ in views]
    left = [np.ones(len(p), bool) for p in pool]  # rows that a view has not labelled yet
    models = [Logistic.fit(x, t) for x, t in zip(fit_x, fit_y, strict=True)]
    given = [[0, 0.0], [0, 0.0]]
    for _ in range(rounds):
        before = given[0][0] + given[1][0]
        for giver, taker in ((0, 1), (1, 0)):
            rows = np.flatnonzero(left[giver])
            if not len(rows):
                continue
            p = _calibrated(models[giver], views[giver][rest], y[rest]).score(models[giver].margin(pool[giver][rows])[:, None])
            for label, share in ((1, y.mean()), (0, 1 - y.mean())):
                sure = p if label else 1 - p
                best = np.argsort(-sure, kind="stable")[: max(1, int(PER_ROUND * share))]
                weight = np.maximum(0, (sure[best] - share) / (1 - share))
                best, weight = rows[best[weight > 0]], weight[weight > 0]
                fit_x[taker] = np.r_[fit_x[taker], pool[taker][best]]
                fit_y[taker] = np.r_[fit_y[taker], np.full(len(best), float(label))]
                weights[taker] = np.r_[weights[taker], weight]
                left[giver][best] = False
                given[giver][0] += len(best)
                given[giver][1] += float(weight.sum())
        models = [Logistic.fit(x, t, weight=w) for x, t, w in zip(fit_x, fit_y, weights, strict=True)]
        if given[0][0] + given[1][0] == before:
            break
    margins = np.c_[models[0].margin(views[0][rest]), models[1].margin(views[1][rest])]
    return Model(models[0], models[1], Logistic.fit(margins, y[rest]), float(y.mean()), tuple(map(tuple, given)))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lang, source, n_chars = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
    return text_features(batch.column("text").to_pylist()), meta_features(lang, source, n_chars)


def _measure(batches):
    for batch in small(batches):
        text, meta = _views(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), batch.column("order"), pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))],
            names=["quality", "order", "x_text", "x_meta"])


_USED = ("doc_id", "text", "lang", "source", "n_chars")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Co-train on at most LABELLED labelled and UNLABELLED other documents.

    Null labels and ids are left out; of a doc_id with several labels the largest counts.
    Only features of the samples reach the driver, a row of bounded width for each document.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.lit(4), "doc_id")
    some = known.select("doc_id", "quality").orderBy(order, "doc_id").limit(LABELLED)
    others = docs.select("doc_id").where("doc_id is not null").join(known, "doc_id", "left_anti").distinct()
    others = others.orderBy(order, "doc_id").limit(UNLABELLED).select("doc_id", F.lit(None).cast("int").alias("quality"))
    # Two numbers for each of at most LABELLED + UNLABELLED documents.
    taken = docs.select(*_USED).join(F.broadcast(some.union(others)), "doc_id").withColumn("order", F.xxhash64(F.lit(4), "doc_id", "text"))
    taken = taken.dropDuplicates(["text", "quality", "lang", "source"])
    rows = taken.select("quality", "order", *_USED[1:]).mapInArrow(_measure, "quality int, order long, x_text array<double>, x_meta array<double>")
    rows = rows.orderBy("order").limit(2 * (LABELLED + UNLABELLED)).collect()
    own, pool = [r for r in rows if r["quality"] is not None], [r for r in rows if r["quality"] is None]

    widths = {"x_text": text_features([None]).shape[1], "x_meta": meta_features([None], [None], [None]).shape[1]}

    def views(part):
        return tuple(np.array([r[c] for r in part], float).reshape(len(part), w) for c, w in widths.items())

    return cotrain(views(own), np.array([r["quality"] for r in own], float), views(pool))


def score(docs: DataFrame, model: Model, keep_from: float = 0.5) -> DataFrame:
    """Quality of every document: doc_id, text_score, meta_score, score and keep.

    `docs` needs (doc_id, text, lang, source, n_chars); other columns are ignored. Null texts
    are empty ones, null metadata a value of its own. Repeated rows get the same score; an
    empty table gives an empty one. Without both labels to learn from, the score is the share
    of good documents (1 without labels). No row is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*_USED).mapInArrow(
        _scorer(docs, model, keep_from, ["doc_id"]), f"doc_id {kind}, text_score double, meta_score double, score double, keep boolean"
    )


def _scorer(docs: DataFrame, model: Model, keep_from: float, carried: list[str]) -> Callable:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small(batches):
            s = sent.value.scores(*_views(batch)).reshape(batch.num_rows, 3)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(s[:, 2]), pa.array(s[:, 2] >= keep_from)],
                names=[*carried, "text_score", "meta_score", "score", "keep"])
    return run


def keep_good(docs: DataFrame, model: Model, keep_from: float = 0.5) -> DataFrame:
    """The documents with a score of at least `keep_from`, with all their columns.

    A null text is an empty one, null metadata a value of its own; without labels of both kinds all
    documents have one score. Repeated rows stay or go together; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small(batches):
            s = sent.value.scores(*_views(batch)).reshape(batch.num_rows, 3)
            yield batch.filter(pa.array(s[:, 2] >= keep_from))

    return docs.mapInArrow(run, docs.schema)

