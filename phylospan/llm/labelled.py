"""Bounded samples of labelled documents for the classifiers, and figures to judge scores by."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id, folds: int):
    """The fold of a document: CRC-32 of its id in decimal, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int | tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray, float]:
    """``(texts, labels, share of label 1)`` from rows outside the held-out fold.

    At most ``per_class`` documents of each label (a pair: of label 1 and of label 0), those of the least hash of the id, so that the sample is
    bounded whatever the table and the same for the same rows.  The share is of all labelled rows outside
    the fold.  Rows with a null id or label, and labels that disagree on a document, are not learned from.
    """
    clean = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    clean = clean.where(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    share = clean.agg(F.avg("y")).first()[0]
    ones, zeros = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    order = F.xxhash64("doc_id")
    chosen = clean.where("y = 1").orderBy(order, "doc_id").limit(ones).unionByName(clean.where("y = 0").orderBy(order, "doc_id").limit(zeros)).select("doc_id", "y")
    wanted = {r.doc_id: r.y for r in chosen.collect()}
    few = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in wanted], "doc_id long"))  # as many ids as per_class allows
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = mine.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text or "" for r in rows], np.array([wanted[r.doc_id] for r in rows], np.int64), 0.5 if share is None else float(share)


def auc(scores, labels) -> float:
    """The chance that a row of label 1 scores above one of label 0; ties count half."""
    scores, labels = np.asarray(scores, float), np.asarray(labels)
    values, place = np.unique(scores, return_inverse=True)
    count = np.bincount(place, minlength=len(values))
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    return float((rank[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Ridge logistic regression on standardised columns by Newton steps: weights, bias, means, scales.

    The bias is moved from the sample's share of label 1 to ``share``.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge * len(x)), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + keep * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1] + prior_shift(y.mean(), share)), mean, scale


def prior_shift(sampled: float, share: float) -> float:
    """What to add to a log-odds learned where label 1 had share ``sampled`` for one where it has ``share``."""
    a, b = (min(max(v, 1e-3), 1 - 1e-3) for v in (sampled, share))
    return float(np.log(b / (1 - b)) - np.log(a / (1 - a)))
