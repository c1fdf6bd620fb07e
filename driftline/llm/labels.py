"""Labelled rows for the classifiers: a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents that aren't held
    out, chosen by a hash of their ids: the same rows on every run.

    Null ids and labels are left out; of repeated labels the largest counts.
    Only ids and labels of the sample are broadcast, so their size is bounded
    by ``limit``.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "label")


def adam(parameters: list, gradient, steps: int, rate: float) -> list:
    """Minimise by Adam; ``gradient(parameters)`` gives one array for each."""
    import numpy as np

    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for t in range(1, steps + 1):
        step = rate * min(1.0, 2 * (1 - (t - 1) / steps))
        for i, g in enumerate(gradient(parameters)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            parameters[i] = parameters[i] - step * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-9)
    return parameters
