"""Bounded samples of labelled texts for fitting classifiers, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column) -> Column:
    """crc32 of the id's text modulo 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out: int, per_class: int, most_chars: int) -> list[tuple[int, int, str]]:
    """At most per_class texts of each class as (fold, label, text): those of smallest id hash, none of the held-out fold.

    The rows of labels are chosen first, so that texts are met by a join with a table of bounded size and nothing is
    shuffled whole. An id that is labelled twice counts once, with its larger label, and so does an id with several texts,
    with the least of them; ids without a text are left out.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (fold(F.col("doc_id")) != held_out))
    own = own.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    picked = None
    for value in (0, 1):
        one = own.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    texts = docs.where(F.col("text").isNotNull() & (F.char_length("text") <= most_chars)).select("doc_id", "text")
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    rows = found.select("doc_id", fold(F.col("doc_id")).alias("fold"), "label", "text").collect()
    return [(r.fold, r.label, r.text) for r in sorted(rows, key=lambda r: r.doc_id)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last for the constant) by Newton's method; a single class gives its smoothed rate."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge * len(y))
    penalty[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
