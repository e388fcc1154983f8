"""Bounded labelled samples, and the small numpy fits that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.llm.common import cut


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int) -> DataFrame:
    """``doc_id, text, y`` of up to ``bound`` labelled rows for which ``train`` holds, the same rows each time.

    The rows are those of least id hash, then of least text hash, so every stretch of the corpus is met and
    an id that many rows share takes no more than its part of the bound. Rows that repeat both id and
    text count once. Null labels and ids are skipped, and of several labels of a document the greatest counts.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    met = picked.join(F.broadcast(ids), "doc_id").withColumn("_variant", F.xxhash64("text"))  # at most ``bound`` ids
    keys = cut(met.select("doc_id", "_variant").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_variant").limit(bound), "sample-keys")
    kept = met.join(F.broadcast(keys), ["doc_id", "_variant"])  # at most ``bound`` rows
    return kept.dropDuplicates(["doc_id", "_variant"]).drop("_variant").select("doc_id", "text", "y")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression (last: intercept) by damped Newton steps; the prior alone for one class or none."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
        w[-1] = np.log(rate / (1 - rate))
        return w
    ridge = np.full(x.shape[1], l2 * len(y))
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.asarray(x) @ w[:-1] + w[-1], -35, 35)))
