"""Logistic regression on a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised columns. Returns means, scales and coefficients,
    the last of which is the constant. Without rows of both labels: the constant only."""
    y = np.asarray(y, float)
    weight = np.ones(len(y)) if weight is None else weight
    width = x.shape[1]
    if not len(y):
        return np.zeros(width), np.ones(width), np.zeros(width + 1)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    total, positive = weight.sum(), (weight * y).sum()
    b = np.zeros(width + 1)
    b[-1] = np.log((positive + 0.5) / (total - positive + 0.5))
    if not 0 < y.sum() < len(y):
        return mean, scale, b
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p) + 1e-9)) @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * b)
        b = b + step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def logits(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, b = model
    return np.clip(((x - mean) / scale) @ b[:-1] + b[-1], -30, 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, rows_used=None) -> tuple[DataFrame, dict[int, float]]:
    """Documents with a label, at most `most` of each value, chosen by a hash of the id.
    rows_used: a condition on labels. Returns (doc_id, text, y) and for each value the
    number of labelled rows that one sampled row stands for.

    Null labels or ids don't count; an id labelled twice counts with its smaller label, and
    an id of several rows with its smallest text, so that no id fills the sample.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if rows_used is not None:
        known = known.where(rows_used)
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return sample.select("doc_id", "text", "y"), {y: max(1.0, n / most) for y, n in counts.items()}
