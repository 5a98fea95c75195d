"""Bounded, seeded samples of labelled rows for fitting, and the logistic fits that use them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import remainder, stored

#: Labelled rows that a classifier is fitted on: a documented bound, so the fit costs the same at every size.
SAMPLE_ROWS = 16_384
FOLDS = 5


def held_out(doc_id):
    """The rows whose labels are never learned from."""
    return F.coalesce(remainder(doc_id, FOLDS) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """(doc_id, text, y) of about ``rows`` labelled documents outside the held-out fold, drawn by a hash of the id.

    Of several labels of one id the greatest counts; labels other than 0 and 1 don't count. The drawn ids are few, hence broadcast; the texts are stored, so
    that the fit reads ``docs`` once.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) < int(share * (1 << 52)))
    return stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id"), f"{label}-sample")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept first, by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.diag(np.append(1e-6, np.full(x.shape[1] - 1, ridge)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty, x.T @ (y - p) / len(x) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of an L1 logistic regression by accelerated proximal gradient steps."""
    n, d = x.shape
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w, bias = np.zeros(d), float(np.log(mean / (1 - mean)))
    v, c, t = w.copy(), bias, 1.0
    rate = 4.0 / (np.linalg.norm(np.column_stack((x, np.ones(n))), 2) ** 2 / n + 1e-9)
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y) / n
        new = v - rate * (x.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = c - rate * r.sum()
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (s - 1) / t * (new - w), new_bias + (s - 1) / t * (new_bias - bias)
        w, bias = new, float(new_bias)
    return bias, w
