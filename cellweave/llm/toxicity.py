"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what toxic text has beyond it (words that
several toxic texts share and that are many times rarer in ordinary ones, since labels err and texts quote); the second
follows the first's content, so that both compress ordinary language alike. Words, not windows, are compressed: each
with either dictionary inside a fixed carrier (a tiny input alone would not be compressed at all), and what the words of
a window save with the toxic dictionary is its distance. The README says why. A text's
score comes from the savings of all its windows, calibrated by a logistic regression on labelled texts that the
dictionaries have not seen.

The fit takes at most `per_class` labelled texts of each class, of at most `most_chars` characters; scoring reads
every text whole. Words' savings are cached in a worker up to a bound, which changes no result.

Defined results: null and empty texts, and texts without letters, have no savings and get the score of such texts;
null and repeated doc_ids are ordinary rows; without labels every score is 0.5; one class alone gives its smoothed rate;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, logistic, sample
from .token_files import train
from .tokens import slices

PER_CLASS, MOST_CHARS = 4_000, 20_000
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 32_768, 2_048, 6
WINDOW, MIN_TEXTS, CACHE = 32, 3, 1_000_000
#: A word counts as toxic where its share of toxic texts is at least so many times its share of ordinary ones: one of these, by
#: cross-validation on so many of the training texts at most.
TIMES, CHOOSING = (5, 10, 20, 40), 1_500
#: Compressed together with each word; both dictionaries end with it.
CARRIER = bytes(range(0x41, 0x5B)) + b"0123456789" + bytes(range(0xA1, 0xC1))
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    level: int = LEVEL


FEATURES = 4


class Scorer:
    """Savings of words and windows under a model's dictionaries."""

    def __init__(self, model: Model):
        self.weights = model.weights
        self.both = [self._compressor(model.ordinary + CARRIER, model.level), self._compressor(model.ordinary + model.toxic + CARRIER, model.level)]
        self.known: dict[str, int] = {}

    @staticmethod
    def _compressor(content: bytes, level: int):
        import zstandard

        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def saving(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= CACHE:
                self.known = {}
            data = b" " + word.encode() + b" " + CARRIER
            got = self.known[word] = len(self.both[0](data)) - len(self.both[1](data))
        return got

    def features(self, text: str) -> list[float]:
        """Of a whole text: best window's saving and its large savings, and both for the whole text by 100 words."""
        found = _WORD.findall(text.lower())
        if not found:
            return [0.0] * FEATURES
        x = np.fromiter(map(self.saving, found), np.int32, len(found))
        strong = np.where(x >= 3, x, 0)
        sums = [np.add.reduceat(v, range(0, len(v), WINDOW // 2)) for v in (x, strong)]
        best = [float((v[:-1] + v[1:]).max() if len(v) > 1 else v[0]) for v in sums]
        n = len(x)
        return [min(best[0], 30) / 10, min(best[1], 30) / 10, float(np.clip(x.sum() * 100 / n, -50, 50)) / 10, min(strong.sum() * 100 / n, 50.0) / 10]

    def score(self, texts: list[str]) -> np.ndarray:
        f = np.array([self.features(t) for t in texts]).reshape(len(texts), FEATURES)
        return 1 / (1 + np.exp(-np.clip(f @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _auc(scores: np.ndarray, labels: np.ndarray) -> float:
    """Pairs of a toxic and an ordinary text that the scores put in order; ties count half."""
    order = np.sort(scores[labels == 0])
    wins = np.searchsorted(order, scores[labels == 1], "left") + np.searchsorted(order, scores[labels == 1], "right")
    return float(wins.sum()) / 2 / max(1, int((labels == 1).sum()) * len(order))


def chosen_times(rows: list[tuple[int, int, str]], level: int = LEVEL) -> float:
    """The one of TIMES with the best mean AUC when each half of the training folds scores the other; of equal ones the first."""
    rows = rows[:CHOOSING]
    halves = [[r for r in rows if r[0] % 2 == k] for k in (0, 1)]
    if any(len({r[1] for r in h}) < 2 for h in halves):
        return float(TIMES[len(TIMES) // 2])
    found = []
    for times in TIMES:
        scores = [_auc(Scorer(fit_texts(a, level, times)).score([r[2] for r in b]), np.array([r[1] for r in b])) for a, b in (halves, halves[::-1])]
        found.append(sum(scores) / 2)
    return float(TIMES[int(np.argmax(np.round(found, 4)))])


def fit_texts(rows: list[tuple[int, int, str]], level: int = LEVEL, times: float | None = None) -> Model:
    """A model from (fold, label, text): dictionaries from the texts of even place, calibration from the others."""
    if not rows:
        return Model(level=level)
    times = chosen_times(rows, level) if times is None else times
    learn, judge = rows[::2], rows[1::2] or rows
    by = {v: [_WORD.findall(t.lower()) for _, label, t in learn if label == v] for v in (0, 1)}
    plain_texts = Counter(w for words in by[0] for w in set(words))
    texts = {" ".join(words): words for words in by[1]}.values()
    shared = Counter(w for words in texts for w in set(words))
    picked = {w for w, n in shared.items() if n >= MIN_TEXTS and n * len(by[0]) >= times * plain_texts[w] * len(texts)}
    beyond = [(" " + " ".join(dict.fromkeys(w for w in words if w in picked)) + " ").encode() for words in texts]
    plain = [" ".join(words[k : k + 8]).encode() for words in by[0] for k in range(0, len(words), 8)]
    ordinary = train(plain, ORDINARY_BYTES + 1_024, k=64, d=8)[-ORDINARY_BYTES:]
    toxic = train([b for b in beyond if len(b) > 8], TOXIC_BYTES + 1_024, k=16, d=6)[-TOXIC_BYTES:]
    model = Model(ordinary, toxic, level=level)
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for _, _, t in judge])
    model.weights = logistic(x, np.array([float(label) for _, label, _ in judge]), ridge=1e-4)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out: int = 0, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    return fit_texts(sample(docs, labels, label_col, held_out, per_class, most_chars))


def score(docs: DataFrame, model: Model, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every text, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for rows in slices(batches):
            s = scorer.score([r["text"] or "" for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["held_out"] for r in rows]), pa.array(s), pa.array((s >= threshold).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
