"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its potentials come from its own features, from its
neighbours' and from the label of the line before. Labels exist for documents
only, so training alternates: lines start with their document's label, a line
model is fitted, lines of bad documents that look good turn good, and the field
is fitted to what results. The score of a document is the length-weighted mean
of its lines' forward-backward marginals, mapped to a probability by a logistic
curve fitted on the same documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import PART, WHITE, batch_of, map_batches, parts, segment_sum, slices, span_hashes, words
from driftline.llm.labels import adam, held_out, labelled_sample

#: Labelled documents that the model is fitted on at most.
SAMPLE = 4000
THRESHOLD = 0.7


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_LINE_END = _table(b"\n")
_CLASSES = [_table(b"!?"), _table(b"%$#*&@^~_=+<>\\{}[]"), _table(b"|"), _table(b"0123456789"), _table(b".,;:")]
OWN = 12
FEATURES = OWN + 2 * 6


def _own_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line of bytes that end with a line end: its own features, its
    length and its hash."""
    cuts = np.flatnonzero(data == 10) + 1
    begin = np.append(0, cuts[:-1])
    bounds = np.append(begin, len(data))

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[bounds]).astype(np.float64)

    wide = np.zeros(len(data), dtype=bool)
    wide[1:] = data[:-1] == 0xC3  # the two-byte letters of Western Europe
    upper = _UPPER[data] | wide & (data >= 0x80) & (data <= 0x9E)
    lower = _LOWER[data] | wide & (data > 0x9E)
    n_upper, n_lower = share(upper), share(lower)
    letters = n_upper + n_lower
    counts = [share(c[data]) for c in _CLASSES]
    starts, ends = words(data, WHITE)
    line_of = np.searchsorted(begin, starts, side="right") - 1
    n_words = np.bincount(line_of, minlength=len(begin)).astype(np.float64)
    hashes = span_hashes(data, starts, ends)
    same = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of[1:][same], minlength=len(begin))
    length = np.diff(bounds) - 1.0
    w = np.maximum(n_words, 1)
    own = np.zeros((len(begin), OWN), dtype=np.float32)
    own[:, 0] = 1
    own[:, 1] = n_upper / np.maximum(letters, 1)
    for j, c in enumerate(counts[:3]):
        own[:, 2 + j] = np.minimum(2 * c / w, 2)
    own[:, 5] = repeats / w
    own[:, 6] = counts[3] / np.maximum(length, 1)
    own[:, 7] = np.minimum(counts[4] / w, 2)
    own[:, 8] = np.minimum(letters / w, 20) / 10
    own[:, 9] = np.log1p(length) / 10
    own[:, 10] = n_words < 3
    return own, length, span_hashes(data, begin, cuts - 1)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), byte lengths, and line offsets by text.
    Every text has a line at least; an empty one has length 0. A very long text
    is taken in parts that end with a line."""
    if len(texts) == 1 and len(texts[0]) > PART:
        found = [_own_features(np.frombuffer(p, dtype=np.uint8)) for p in parts(texts[0] + b"\n", _LINE_END)]
        own, length, whole = (np.concatenate(x) for x in zip(*found, strict=True))
        offsets = np.array([0, len(own)])
    else:
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        own, length, whole = _own_features(data)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        offsets = np.searchsorted(np.append(0, np.cumsum(length + 1)), at)
    # Lines that occur more than once in their document.
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    _, inverse, often = np.unique(whole ^ (doc.astype(np.uint64) << np.uint64(40)), return_inverse=True, return_counts=True)
    own[:, 11] = (often[inverse] > 1) & (length > 0)
    out = np.zeros((len(own), FEATURES), dtype=np.float32)
    out[:, :OWN] = own
    inner = np.ones(len(own), dtype=bool)
    inner[offsets[:-1]] = False
    i = np.flatnonzero(inner)
    out[i, OWN : OWN + 6] = own[i - 1, 1:7]
    out[i - 1, OWN + 6 :] = own[i, 1:7]
    return out, length, offsets


def chain(scores: np.ndarray, offsets: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once: P(bad) of every line, and
    P(label before, label) of every line but the first of its chain."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    first, n = offsets[:-1][order], n[order]
    emit = np.exp(np.clip(np.stack([np.zeros_like(scores), scores], axis=1), -30, 30))
    move = np.exp(transition)
    forward, backward = np.ones((len(scores), 2)), np.ones((len(scores), 2))
    active = [int(np.searchsorted(-n, -t, side="right")) for t in range(1, int(n[0]) + 1)] if len(n) else []
    for t, k in enumerate(active):
        i = first[:k] + t
        a = emit[i] if t == 0 else emit[i] * (forward[i - 1] @ move)
        forward[i] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(active) - 1, 0, -1):
        i = first[: active[t]] + t
        b = (emit[i] * backward[i]) @ move.T
        backward[i - 1] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    bad = both[:, 1] / both.sum(axis=1)
    inner = np.ones(len(scores), dtype=bool)
    inner[offsets[:-1]] = False
    i = np.flatnonzero(inner)
    pair = forward[i - 1][:, :, None] * move[None] * (emit[i] * backward[i])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return bad, pair


@dataclass
class QualityModel:
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    intercept: float

    def badness(self, texts: list[bytes]) -> np.ndarray:
        x, length, offsets = line_features(texts)
        return self._badness(x, length, offsets)

    def _badness(self, x: np.ndarray, length: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bad, _ = chain(x @ self.weights, offsets, self.transition)
        weight = length + 1e-6
        return segment_sum(bad * weight, offsets) / segment_sum(weight, offsets)

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.intercept - self.slope * self.badness(texts)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, length: np.ndarray, offsets: np.ndarray, good: np.ndarray) -> QualityModel:
    """Fit to the lines of documents and their labels. Without both labels
    present, the field is flat and every score is the share of good labels (0.99
    if there are none: nothing speaks against a document)."""
    good = np.asarray(good, dtype=float)
    base = float(np.clip(good.mean(), 0.01, 0.99)) if len(good) else 0.99
    if not len(good) or good.min() == good.max():
        return QualityModel(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, float(np.log(base / (1 - base))))
    n = np.diff(offsets)
    doc_bad = np.repeat(1 - good, n)
    label = doc_bad.copy()
    weights = np.zeros(FEATURES)
    for _ in range(3):
        rate = (label == 1).mean()
        balance = np.where(label == 1, 0.5 / max(rate, 1e-3), 0.5 / max(1 - rate, 1e-3))

        def slope(p: list) -> list:
            return [x.T @ ((_sigmoid(x @ p[0]) - label) * balance) / len(label) + 1e-4 * p[0]]  # noqa: B023

        (weights,) = adam([weights], slope, 120, 0.3)
        looks = x @ weights
        # The worst line of a bad document stays bad, whatever it looks like.
        order = np.lexsort((-looks, np.repeat(np.arange(len(n)), n)))
        worst = np.zeros(len(label), dtype=bool)
        worst[order[offsets[:-1]]] = True
        label = np.where(doc_bad == 1, (looks > 0) | worst, False).astype(float)

    inner = np.ones(len(label), dtype=bool)
    inner[offsets[:-1]] = False
    i = np.flatnonzero(inner)
    seen = np.bincount((label[i - 1] * 2 + label[i]).astype(int), minlength=4).reshape(2, 2)

    def field(p: list) -> list:
        bad, pair = chain(x @ p[0], offsets, p[1])
        return [x.T @ (bad - label) / len(label) + 1e-4 * p[0], (pair.sum(axis=0) - seen) / len(label) + 1e-3 * p[1]]

    weights, transition = adam([weights, np.zeros((2, 2))], field, 100, 0.1)
    model = QualityModel(weights, transition, 1.0, 0.0)
    q = model._badness(x, length, offsets)

    def curve(p: list) -> list:
        e = _sigmoid(p[0][0] - p[0][1] * q) - good
        return [np.array([e.mean(), -(e * q).mean() + 1e-4 * p[0][1]])]

    ((model.intercept, model.slope),) = adam([np.array([2.0, 8.0])], curve, 400, 0.2)
    return model


_LINES = pa.schema([("label", pa.int32()), ("place", pa.int64()), ("x", pa.list_(pa.float32())), ("length", pa.list_(pa.float64()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def _score(model: QualityModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        yield batch_of(_OUT, [batch.column(0), batch.column(1), model.score(texts)])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        x, length, offsets = line_features(texts)
        wide = pa.array(offsets * FEATURES, pa.int32())
        columns = [pa.ListArray.from_arrays(wide, pa.array(x.ravel())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(length))]
        order = [zlib.crc32(t) << 31 | len(t) & 0x7FFFFFFF for t in texts]
        yield batch_of(_LINES, [batch.column(1), order, *columns])


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> QualityModel:
    """The driver gets the line features of at most ``limit`` documents."""
    sample = map_batches(labelled_sample(docs, labels, "quality", limit), _lines, "label int, place long, x array<float>, length array<double>").toArrow()
    if not sample.num_rows:
        return fit(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(1, np.int64), np.zeros(0))
    # A fixed order of documents: sums depend on it in the last digits.
    sample = sample.sort_by([("place", "ascending"), ("label", "ascending")]).combine_chunks()
    x, length = sample["x"].combine_chunks(), sample["length"].combine_chunks()
    offsets = np.append(0, np.cumsum(np.diff(length.offsets.to_numpy())))
    return fit(x.flatten().to_numpy().reshape(-1, FEATURES), length.flatten().to_numpy(), offsets, sample["label"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score (probability of label 1), predicted.

    A null text is empty: one empty line. Very long texts are featured in
    parts; the chain runs over all their lines. Null and repeated ids are kept
    row for row; labels without a document are ignored; other columns are never
    read; an empty table stays empty.
    """
    model = train(docs, labels, limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = map_batches(rows, partial(_score, model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep(model: QualityModel, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        yield batch.filter(pa.array(model.score(texts) >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject."""
    return map_batches(docs, partial(_keep, train(docs, labels, limit), threshold), docs.schema)
