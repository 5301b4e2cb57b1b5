"""What the classifiers share: folds, bounded samples of labelled rows, and logistic fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def least_by_hash(rows: DataFrame, most: int, *salt: Column) -> DataFrame:
    """The ``most`` rows of the least hashes of doc_id, which a sort of about that many finds.

    Rows are counted first, and those whose hashes are surely too great are left out where
    they are, so that neither a task nor the driver gets ``most`` rows of every partition.
    """
    n = rows.count()
    share = min(1.0, (most + 6 * math.sqrt(most) + 10) / max(1, n))
    h = F.xxhash64("doc_id", *salt)
    some = rows if share == 1.0 else rows.filter(h <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 0.5 else int((share - 0.5) * 2**64)).cast("long"))
    return some.orderBy(h, *[c for c in rows.columns if c != "text"]).limit(most)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and _y of up to ``most`` labelled documents outside the held-out fold, chosen by hash of the id.

    Only the chosen ids are joined with the texts; ``most`` bounds that side.  A doc_id counts once: of repeated
    labels the highest, of repeated rows the least text.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    one = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_y"))
    chosen = least_by_hash(one, most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").alias("_y"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, *, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept for targets from 0 to 1, by Newton steps; ``l2`` spares the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    c = np.ones(len(y)) if weight is None else weight
    ridge = np.full(a.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (c * (p - y)) + ridge * w
        h = (a * (c * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        d = np.linalg.solve(h, g)
        d *= min(1.0, 10.0 / max(1e-12, np.abs(d).max()))
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """Area under the ROC curve; ties count half."""
    _, inv, counts = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inv]
    n1 = int((y == 1).sum())
    n0 = len(y) - n1
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * n0))
