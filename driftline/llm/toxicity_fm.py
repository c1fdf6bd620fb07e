"""Toxicity by a factorization machine over hashed terms.

A document is the set of its distinct terms, hashed to buckets. Buckets whose
presence says something about the label in the training sample (chi-squared
with one degree of freedom above ``CHI2``) are active; each has a weight and a
vector of factors, and the log odds are::

    w0 + sum w_i + sum_{i<j} <v_i, v_j>

so that two terms can mean more, or less, together than their weights add up
to. The pair sum takes time linear in the terms: (|sum v|^2 - sum |v|^2) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import batch_of, list_column, map_batches, segment_sum, slices, word_hashes
from driftline.llm.labels import adam, held_out, labelled_sample

SAMPLE = 20_000  # labelled documents that the model is fitted on at most
BITS = 22
FACTORS = 8
CHI2 = 15.0
THRESHOLD = 0.3

#: Terms are runs of ASCII letters, digits and bytes beyond ASCII.
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, sorted, and offsets by text."""
    hashes, offsets = word_hashes(texts, _BREAK)
    bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keys = np.unique(text << BITS | bucket)
    return keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(len(texts) + 1) << BITS)


@dataclass
class FactorizationMachine:
    active: np.ndarray  # sorted buckets
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def _select(self, buckets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.active):
            return np.zeros(0, dtype=np.int64), np.zeros_like(offsets)
        at = np.minimum(np.searchsorted(self.active, buckets), len(self.active) - 1)
        hit = self.active[at] == buckets
        return at[hit], np.append(0, np.cumsum(hit))[offsets]

    def score(self, texts: list[bytes]) -> np.ndarray:
        at, offsets = self._select(*term_buckets(texts))
        z = _odds(self.bias, self.weights, self.factors, at, offsets)[0]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _odds(bias: float, weights: np.ndarray, factors: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = factors[at]
    total = _sums(v, offsets)
    pairs = 0.5 * ((total**2).sum(axis=1) - segment_sum((v**2).sum(axis=1), offsets))
    return bias + segment_sum(weights[at].astype(float), offsets) + pairs, total


def fit(buckets: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> FactorizationMachine:
    """Fit to bucket sets and labels. With one label only, or no document, the
    score is a constant: the share of toxic labels, 0.05 if there are none."""
    toxic = np.asarray(toxic, dtype=float)
    n = len(toxic)
    base = float(np.clip(toxic.mean(), 0.001, 0.999)) if n else 0.05
    prior = float(np.log(base / (1 - base)))
    if not n or toxic.min() == toxic.max():
        return FactorizationMachine(np.zeros(0, np.int64), prior, np.zeros(0), np.zeros((0, FACTORS)))
    doc = np.repeat(np.arange(n), np.diff(offsets))
    seen = np.bincount(buckets, minlength=1 << BITS).astype(float)
    with_ = np.bincount(buckets, weights=toxic[doc], minlength=1 << BITS)
    expect = seen * toxic.mean()
    spread = expect * (1 - toxic.mean()) * (1 - seen / n) + 1e-12
    active = np.flatnonzero((seen >= 3) & ((with_ - expect) ** 2 / spread > CHI2))
    model = FactorizationMachine(active, prior, np.zeros(len(active)), np.zeros((len(active), FACTORS)))
    at, cut = model._select(buckets, offsets)
    rows = np.repeat(np.arange(n), np.diff(cut))
    factors = np.random.RandomState(7).normal(0, 0.05, (len(active), FACTORS))

    def slope(p: list) -> list:
        z, total = _odds(p[0][0], p[1], p[2], at, cut)
        e = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - toxic) / n
        r = e[rows]
        gw = np.bincount(at, weights=r, minlength=len(active))
        inside = (total[rows] - p[2][at]) * r[:, None]
        gv = np.stack([np.bincount(at, weights=inside[:, f], minlength=len(active)) for f in range(FACTORS)], axis=1)
        return [np.array([e.sum()]), gw + 1e-6 * p[1], gv + 1e-5 * p[2]]

    bias, weights, factors = adam([np.array([prior]), np.zeros(len(active)), factors], slope, 200, 0.15)
    return FactorizationMachine(active, float(bias[0]), weights, factors)


_FEATURES = pa.schema([("label", pa.int32()), ("buckets", pa.list_(pa.int32()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        buckets, offsets = term_buckets(texts)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(buckets, pa.int32()))
        yield batch_of(_FEATURES, [batch.column(1), lists])


def _score(model: FactorizationMachine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        yield batch_of(_OUT, [batch.column(0), batch.column(1), model.score(texts)])


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> FactorizationMachine:
    """The driver gets the bucket numbers of at most ``limit`` documents."""
    got = map_batches(labelled_sample(docs, labels, "toxic", limit), _features, "label int, buckets array<int>").toArrow()
    if not got.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0))
    lists = pa.concat_arrays(got["buckets"].chunks)
    buckets, offsets = lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    label = got["label"].to_numpy()
    # Sums depend on the order of rows in the last digits: sort them first.
    key = segment_sum(buckets * buckets % 1_000_003, offsets)
    order = np.lexsort((label, np.diff(offsets), key))
    flat = np.concatenate([buckets[offsets[i] : offsets[i + 1]] for i in order])
    return fit(flat, np.append(0, np.cumsum(np.diff(offsets)[order])), label[order])


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score (probability of label 1), predicted.

    A null text is empty and gets the score of a document without terms. Null
    and repeated ids are kept row for row; labels without a document are
    ignored; other columns are never read; an empty table stays empty.
    """
    model = train(docs, labels, limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = map_batches(rows, partial(_score, model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
