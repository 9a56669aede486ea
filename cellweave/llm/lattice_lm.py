"""Likelihood of texts under a subword lattice: the pieces of an existing vocabulary weight all segmentations.

Pieces never cross white space in this vocabulary, so a text's marginal probability is the product of its words' and
of the end's. A word's is summed over all ways to cut it into pieces (and, for any character, its bytes) by the forward
recursion in log space. The pieces' scores are unigram log probabilities: how often the vocabulary's own segmentation
uses each piece in the training words, smoothed by 0.5; with the end they add up to 1.

Work follows the words, not the texts: training counts are grouped by word over the whole table, each distinct word
is scored once, and texts get their words' scores back by a join on the word. Words so common that they make at least
1 / HOT of all (there are at most HOT of them) are kept out of that join and sent to all tasks instead, so that no
key of it is hot.

Defined results: null and blank texts have only the end; without training texts all counts are 0 and pieces have equal
scores; null and repeated doc_ids are ordinary rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .labelled import fold
from .tokens import slices

HOT, KINDS_HELD = 20_000, 400_000
SPACE_MARK = "▁"
LN10 = math.log(10)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes' methods know ASCII only, as the contract asks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, trained and total: occurrences in training texts and in all. The word null stands for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        ends = [0, 0]

        def flush() -> pa.RecordBatch:
            kinds = list(held[0].keys() | held[1].keys())
            trained = [held[1].get(w, 0) for w in kinds]
            total = [held[0].get(w, 0) + t for w, t in zip(kinds, trained, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array([*kinds, None], pa.binary()), pa.array([*trained, ends[1]], pa.int64()), pa.array([*total, sum(ends)], pa.int64())], ["word", "trained", "total"])
            for c in held:
                c.clear()
            ends[:] = 0, 0
            return out

        for rows in slices(batches):
            for r in rows:
                held[r["training"]].update(_words(r["text"]))
                ends[r["training"]] += 1
            if len(held[0]) + len(held[1]) > KINDS_HELD:
                yield flush()
        yield flush()

    return docs.mapInArrow(run, "word binary, trained long, total long").groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total"))


def _segmenter(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_scores(counted: DataFrame, vocabulary: str) -> tuple[list[float], float]:
    """Log probability of every piece of the vocabulary, and of the end. The sums have a row for each piece at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = _segmenter(vocabulary), Counter()
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch["word"].to_pylist()]
            for ids, n in zip(model.encode(texts, num_threads=1), batch["trained"].to_pylist(), strict=True):
                for i in ids:
                    sums[i] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], ["piece", "n"])

    found = counted.where("word is not null and trained > 0").select("word", "trained").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    ends = counted.where("word is null").agg(F.sum("trained").alias("n")).first().n or 0
    size = _segmenter(vocabulary).get_piece_size()
    n = {r.piece: r.n for r in found}
    total = math.log(sum(n.values()) + ends + 0.5 * (size + 1))
    return [math.log(n.get(i, 0) + 0.5) - total for i in range(size)], math.log(ends + 0.5) - total


class Lattice:
    """Marginal log probability of words."""

    def __init__(self, vocabulary: str, scores: list[float]):
        model = _segmenter(vocabulary)
        self.pieces: dict[str, float] = {}
        self.bytes = [-math.inf] * 256
        for i, s in enumerate(scores):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = s
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.pieces[model.id_to_piece(i)] = s
        self.longest = max(map(len, self.pieces), default=1)
        self.starts = {p[:2] for p in self.pieces if len(p) > 1}

    def word(self, word: bytes) -> float:
        text = SPACE_MARK + word.decode("utf-8", "replace")
        n, get, starts, exp, log = len(text), self.pieces.get, self.starts, math.exp, math.log
        into: list[list[float]] = [[] for _ in range(n + 1)]
        a = 0.0
        for i in range(n):
            if i:
                terms = into[i]
                into[i] = []
                if len(terms) == 1:
                    a = terms[0]
                else:
                    top = max(terms)
                    a = top + log(sum([exp(t - top) for t in terms]))
            char = text[i]
            into[i + 1].append(a + sum([self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]))
            if (s := get(char)) is not None:
                into[i + 1].append(a + s)
            if text[i : i + 2] in starts:
                for j in range(i + 2, min(n, i + self.longest) + 1):
                    if (s := get(text[i:j])) is not None:
                        into[j].append(a + s)
        top = max(into[n])
        return top + log(sum([exp(t - top) for t in into[n]]))


def score(docs: DataFrame, held_out: int = 1, vocabulary: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every text."""
    path = vocabulary or default_vocabulary()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id")) != held_out).alias("training"))
    counted = materialize(word_counts(own), "lm-counts")
    scores, end = piece_scores(counted, path)
    sums = counted.agg(F.sum("trained").alias("n"), F.sum("total").alias("all"), F.count_if(F.col("trained") > 0).alias("kinds")).first()
    n, kinds, everything = sums.n or 0, sums.kinds or 0, sums.all or 0
    smooth = math.log10(n + 0.5 * (kinds + 1)) if n + kinds else math.log10(0.5)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, scores)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in batch.schema.names], pa.array([lattice.word(w) / LN10 for w in batch["word"].to_pylist()], pa.float64())], [*batch.schema.names, "lm"])

    weighed = materialize(counted.where("word is not null").mapInArrow(weigh, "word binary, trained long, total long, lm double"), "lm-words")
    most = weighed.where(F.col("total") * hot >= everything).collect()  # at most `hot` words make so large a share each
    base_of = lambda c: math.log10(c + 0.5) - smooth
    sent = own.sparkSession.sparkContext.broadcast({bytes(r.word): (int(r.trained > 0), base_of(r.trained), r.lm) for r in most})
    ends = counted.where("word is null").agg(F.sum("trained").alias("n")).first().n or 0
    of_end = (int(ends > 0), base_of(ends), end / LN10)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with what each text has from the end and from common words, and a row for each of its other words."""
        from pyspark import TaskContext

        known, key = sent.value, TaskContext.get().partitionId() << 33
        for rows in slices(batches):
            heads: list[tuple] = []
            words: list[bytes] = []
            keys: list[int] = []
            times: list[int] = []
            for r in rows:
                found = _words(r["text"])
                seen, base, lm = of_end
                for w, t in Counter(found).items():
                    got = known.get(w)
                    if got is None:
                        words.append(w)
                        keys.append(key)
                        times.append(t)
                    else:
                        seen += t * got[0]
                        base += t * got[1]
                        lm += t * got[2]
                heads.append((key, r["doc_id"], not r["training"], len(found) + 1, seen, base, lm))
                key += 1
            k, i, h, t, s, b, m = zip(*heads, strict=True)
            tail = len(words)
            none = [None] * tail
            cols = [([*k, *keys], pa.int64()), ([*i, *none], pa.int64()), ([*h, *none], pa.bool_()), ([*t, *none], pa.int64()), ([*s, *none], pa.int64()), ([*b, *none], pa.float64()), ([*m, *none], pa.float64()), ([None] * len(heads) + words, pa.binary()), ([None] * len(heads) + times, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in cols], ["key", "doc_id", "held_out", "n_tokens", "seen", "base", "lm", "word", "times"])

    rows = materialize(own.mapInArrow(parts, "key long, doc_id long, held_out boolean, n_tokens long, seen long, base double, lm double, word binary, times long"), "lm-parts")
    tail = rows.where("word is not null").select("key", "word", "times").join(weighed.select("word", "trained", F.col("lm").alias("word_lm")), "word")
    base = F.log10(F.col("trained") + F.lit(0.5)) - F.lit(smooth)
    tail = tail.groupBy("key").agg(F.sum(F.when(F.col("trained") > 0, F.col("times")).otherwise(0)).alias("seen2"), F.sum(F.col("times") * base).alias("base2"), F.sum(F.col("times") * F.col("word_lm")).alias("lm2"))
    zero = F.lit(0.0)
    return (
        rows.where("n_tokens is not null")
        .join(tail, "key", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("seen") + F.coalesce("seen2", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("base2", zero)).alias("base_score"),
            (F.col("lm") + F.coalesce("lm2", zero)).alias("score"),
        )
    )
