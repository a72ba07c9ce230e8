"""Bounded samples of labelled texts, and logistic fits on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id, text, y``: distinct labelled texts that aren't held out, at most ``per_class`` of each class, whole.

    The choice is by a hash of the id, so it is the same each time; an id's rows with several texts count as one
    of them, by a hash too. Rows whose label is null or neither 0 nor 1 count as unlabelled, as do null texts;
    where an id has several labels, the smallest holds.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    ranked = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # The sample of ids has a bound, at most 2 * per_class rows of 12 bytes.
    chosen = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ranked[0].union(ranked[1])), "doc_id")
    one = chosen.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r")).select("doc_id", "r.*")
    return one.groupBy(F.xxhash64("text").alias("t")).agg(F.min_by(F.struct("doc_id", "text", "y"), "doc_id").alias("r")).select("r.*")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on targets from 0 to 1, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        scale = min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w -= scale * step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
