"""Bounded samples of labelled rows, and small numeric helpers that the trained operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 6000  # labelled rows a classifier is fitted on, at most about
MAX_CHARS = 24_000_000  # and characters in them


def remainder(doc_id, by: int):
    """crc32 of doc_id as text, modulo by; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def sampled(rows: DataFrame, key: str, chars: str, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, by: str | None = None) -> DataFrame:
    """The rows whose hashed key falls under the share that keeps about max_rows rows and max_chars characters.

    The share is one number for all rows, or one for each value of `by` (few values), which then get equal room.
    """
    group = F.col(by).cast("string") if by else F.lit("")
    found = rows.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("c")).collect()
    share = F.lit(0.0)
    for g, n, c in found:
        part = min(1.0, max_rows / len(found) / n, max_chars / len(found) / max(c or 0, 1))
        share = F.when(group.eqNullSafe(F.lit(g)), part).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))


def labelled(docs: DataFrame, labels: DataFrame, label: str, by: int = 5, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, text, y) of a bounded sample of the rows one may learn from: crc32(doc_id) mod `by` isn't 0, label 0 or 1.

    A doc_id with several labels counts with the largest.  The sample of labels is bounded, so it is broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & (remainder("doc_id", by) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = sampled(known.withColumn("one", F.lit(1)), "doc_id", "one", 2 * max_rows, by="y")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")
    return sampled(rows.withColumn("chars", F.length("text")), "doc_id", "chars", max_rows, max_chars, by="y").select("doc_id", "text", "y")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by damped Newton steps: (mean, scale, coefficients with the intercept last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    v = np.ones(len(x)) if weight is None else weight
    pull = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    loss = lambda w: float(v @ np.logaddexp(0, np.where(y > 0, -(z @ w), z @ w)) + w @ pull @ w / 2)
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (v * p * (1 - p))[:, None]).T @ z + pull, z.T @ (v * (p - y)) + pull @ w)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return mean, scale, w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))
