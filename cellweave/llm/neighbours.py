"""Quality by nearest-neighbour voting on latent-semantic vectors.

A text becomes hashed counts of its words, of their shapes (letters, digits and marks, runs shortened) and of words
that repeat the one before or come too often, weighted by inverse document frequency over all texts; a truncated
singular value decomposition of labelled texts gives the latent axes. The labelled texts' vectors, of bounded number,
go to every task, which takes the exact cosine with each of them for every text, block by block. The score is the share
of label 1 among the nearest neighbours, each weighted by a power of its cosine.

The fit takes at most `per_class` labelled texts of each class, of at most `most_chars` characters. Document
frequencies are counted over the whole table, and every text is scored whole.

Defined results: null and empty texts have a vector of zeros, no neighbours, and the share of label 1 in the sample as
score (0.5 without labels); null and repeated doc_ids are ordinary rows; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, sample
from .tokens import release, slices

PER_CLASS, MOST_CHARS = 3_000, 20_000
FEATURES, AXES, NEAREST, POWER = 2_048, 32, 25, 8.0
BLOCK = 256
_LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"(.)\1+", re.S)


def _slot(token: str) -> int:
    return zlib.crc32(token.encode()) % FEATURES


def _shape(word: str) -> str:
    """Letters as a, or A where two or more are upper case, digits as 0, runs of anything as two of it."""
    core = word.rstrip(",.")
    if core.isalpha() and (len(core) == 1 or not core.isupper()):
        return "a" + word[len(core) :][:2]
    letters = lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a"
    return _RUNS.sub(r"\1\1", re.sub(r"\d+", "0", _LETTERS.sub(letters, word)))


def counts(texts: list[str]) -> np.ndarray:
    """1 + log of the hashed counts, a row for each text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    crc = zlib.crc32
    for k, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        n = len(words)
        by_word = Counter(words)
        shapes: dict[str, int] = {}
        for w, c in by_word.items():
            s = "a" if w.isalpha() and w.islower() else _shape(w)
            shapes[s] = shapes.get(s, 0) + c
        row = np.bincount([crc(w) % FEATURES for w in map(str.encode, map(str.lower, by_word))], list(by_word.values()), FEATURES)
        for s, c in shapes.items():
            row[_slot("s " + s)] += c
        again = sum(map(str.__eq__, words, words[1:]))
        for name, share in (("again", again / n), ("top", max(by_word.values()) / n if n >= 8 else 0.0), ("kinds", 1 - len(by_word) / n)):
            # a share as a count that weighs like as many words: coarse, so that texts of one kind agree
            if share >= 0.25:
                row[_slot(f"t {name} {int(share * 4)}")] += n
        at = np.flatnonzero(row)
        out[k, at] = 1 + np.log(row[at])
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, texts: list[str]) -> np.ndarray:
        x = counts(texts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        y = x @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str], nearest: int = NEAREST, power: float = POWER) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), BLOCK):
            y = self.embed(texts[at : at + BLOCK])
            cosines = y @ self.vectors.T
            k = min(nearest, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0.0).astype(float) ** power
            total = weight.sum(1)
            share = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            out[at : at + BLOCK] = np.where(total > 1e-9, share, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit_texts(rows: list[tuple[int, int, str]], document_frequency: np.ndarray, documents: int, axes: int = AXES) -> Model:
    """A model from (fold, label, text) and the document frequencies of all features."""
    idf = (np.log((documents + 1) / (document_frequency + 1)) + 1).astype(np.float32)
    labels = np.array([label for _, label, _ in rows], float)
    if not rows:
        return Model(idf, np.zeros((FEATURES, axes), np.float32), np.zeros((0, axes), np.float32), labels, 0.5)
    # The right singular vectors come from the features' second moments, summed over blocks of texts.
    moments = np.zeros((FEATURES, FEATURES), np.float32)
    for at in range(0, len(rows), BLOCK):
        x = counts([t for _, _, t in rows[at : at + BLOCK]]) * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        moments += x.T @ x
    # Subspace iteration: a few products give the leading axes.
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((FEATURES, axes + 16)).astype(np.float32))[0]
    for _ in range(12):
        q = np.linalg.qr(moments @ q)[0]
    values, turn = np.linalg.eigh(q.T @ moments @ q)
    model = Model(idf, (q @ turn[:, ::-1])[:, :axes].astype(np.float32), np.zeros((0, axes), np.float32), labels, float((labels.sum() + 0.5) / (len(labels) + 1)))
    model.vectors = np.vstack([model.embed([t for _, _, t in rows[at : at + BLOCK]]) for at in range(0, len(rows), BLOCK)])
    return model


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over the whole table: partial sums in the tasks, one vector in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, n = np.zeros(FEATURES, np.int64), 0
        for rows in slices(batches):
            total += (counts([r["text"] or "" for r in rows]) > 0).sum(0)
            n += len(rows)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *total[at].tolist()], pa.int64())], ["slot", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1, np.int64)
    for r in sums:
        out[r.slot] = r.n
    return out[:FEATURES], int(out[FEATURES])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: int = 0, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    return fit_texts(sample(docs, labels, label_col, held_out, per_class, most_chars), *frequencies(docs))


def score(docs: DataFrame, model: Model, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every text, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by per_class, FEATURES and AXES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in slices(batches, BLOCK):
            s = sent.value.score([r["text"] or "" for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["held_out"] for r in rows]), pa.array(s), pa.array((s >= threshold).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with their own columns, whose text scores at least the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield part.filter(pa.array(sent.value.score([t or "" for t in part[place].to_pylist()]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
