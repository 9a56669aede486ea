"""Phrase collocations by Toivonen's sampling: a sample proposes, full passes decide, and failures are followed up.

1. Phrases of 1 to 4 words of a hash sample of the texts, at a lowered count, are the proposal.
2. A pass over all texts counts every word, and every longer phrase whose two parts (without its last word, without its first)
   are proposed: the proposal with its negative border, as far as it occurs.
3. A phrase that reaches the least count without being proposed is a border failure. Failures are added to the proposal and a
   further pass counts what that newly lets in, until a pass finds none: then every frequent phrase has been found, since the
   parts of a frequent phrase are frequent.
4. Phrases are hashes of 64 bits up to here, of which two that agree can only make a count too large. A last pass counts the
   strings of what was found, and that count decides.

Sets of phrases go to the tasks as bit filters of 16 MB at every size. What a filter lets through by chance is counted exactly,
like the rest; so a full filter costs work and changes no result. Counts travel packed by bucket. A lang holds no zero character.

Defined results: null or empty text holds no word; null lang is `und`; doc_id is not read, so null and repeated ids and repeated rows
are ordinary rows; an empty table gives an empty table; other columns are not read. Words keep all characters but A to Z, which become
small. A long text is counted in blocks that end at a mark that ends a piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .packed import PACKED, SCHEMA, buckets, gathered, pack, packed_rows, unpack

LEAST, LONGEST, TOP = 30, 4, 2000
#: Score of a cut: floor(SCALE * a / (l + r)). A candidate goes if a longer one that holds it has at least this percentage of its count.
SCALE, NEARLY = 2_000_000, 80
#: One in so many texts is sampled. A sampled phrase is proposed from half the expected count of a phrase that just reaches the least count on.
SAMPLED = 8
#: Bits of the filter, as a power of two.
FILTER_BITS = 27
#: Bytes of text that are cut at once, and phrases that a task gathers before it hands them on.
BLOCK, GATHERED = 1_000_000, 1_000_000
#: A packed count: hash and number.
HASHED = ("<u8", "<u4")
#: A packed count with its string: words, lang's place among the names before the strings, number and bytes.
STRING = ("u1", "<u4", "<u4", "<u4")
COUNTS = "lang string, n int, phrase string, f long"
#: The marks that end a piece and the spaces between words, fixed by the contract.
MARKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_BASE = 0x5851F42D4C957F2D
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(MARKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the worker."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(max(n, 2 * BLOCK), base, np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD[1]
    x ^= x >> np.uint64(29)
    x *= _ODD[0]
    return x ^ (x >> np.uint64(32))


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of texts that stand one after another: their bytes with one space between words, places, pieces and hashes."""

    def __init__(self, texts: list[bytes], langs: list[int], seeds: np.ndarray):
        data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[data]
        word = kind == 0
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
        start, end = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2)[start]
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        self.lang = np.array(langs, np.int64)[doc]
        up, down = _power(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        self.size = end - start
        self.hash = _mix((sums[end] - sums[start]) * down[start] + seeds[self.lang] + self.size.astype(np.uint64))
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        self.bytes = np.full(int(self.size.sum() + len(start)), 32, np.uint8)
        self.bytes[np.arange(self.size.sum()) + np.repeat(np.arange(len(start)), self.size)] = data[word]

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The strings of n words from each place."""
        first, last = self.start[at], self.start[at + n - 1] + self.size[at + n - 1]
        size = last - first
        ends = np.cumsum(size)
        data = self.bytes[np.arange(ends[-1] if len(at) else 0) + np.repeat(first - ends + size, size)]
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)]).cast(pa.large_string())

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length, the hash of the phrase from each place, which ends in the length less one, and whether it lies in one piece."""
        h = self.hash
        whole = np.ones(len(h), bool)
        for n in range(1, longest + 1):
            if n > 1:
                h = _mix(h[:-1] * _ODD[1] + self.hash[n - 1 :]) if len(h) > 1 else h[:0]
                whole = self.piece[: len(h)] == self.piece[n - 1 : n - 1 + len(h)]
            yield n, h & ~np.uint64(3) | np.uint64(n - 1), whole


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in blocks; a block ends at a mark."""
    while len(text) > BLOCK:
        at = max(text.rfind(bytes([m]), 0, BLOCK) for m in MARKS)
        if at < 0:
            at = min((k for m in MARKS if (k := text.find(bytes([m]), BLOCK)) >= 0), default=len(text) - 1)
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Texts of a task in blocks of bounded size, and the languages that they index."""
    names: dict[str, int] = {}
    texts, langs, size = [], [], 0

    def words() -> tuple[Words, list[str]]:
        return Words(texts, langs, np.array([_seed(x) for x in names], np.uint64)), list(names)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            for block in _cut(text.as_py()):
                texts.append(block)
                langs.append(names.setdefault(lang, len(names)))
                size += len(block)
                if size >= BLOCK:
                    yield words()
                    texts, langs, size = [], [], 0
    if texts:
        yield words()


def _slot(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return h >> np.uint64(58 - (len(bits).bit_length() - 1))


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = _slot(h, bits)
    return bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) == 1


def _hashed(now: Callable | None, before: Callable | None, longest: int, parts: int) -> Callable:
    """Packed counts of phrases' hashes. now: the filter whose phrases' extensions are counted (all are, without one); before: that of earlier passes."""

    def flush(found: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        h, which = np.unique(np.concatenate(found), return_inverse=True)
        f = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        return packed_rows((h >> np.uint64(20)) % np.uint64(parts), 0, [h, f], HASHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = (x() if x else None for x in (now, before))
        found, counts, size = [], [], 0
        for w, _ in _worded(batches):
            last = ever = None
            for n, h, whole in w.hashes(longest):
                if n > 1 and new is not None:
                    whole = whole & last[:-1] & last[1:]
                    if old is not None:
                        whole &= ~(ever[:-1] & ever[1:])
                if n < longest and new is not None:
                    last, ever = _has(new, h), None if old is None else _has(old, h)
                if n == 1 and old is not None:
                    continue
                own, f = np.unique(h[whole], return_counts=True)
                found.append(own)
                counts.append(f)
                size += len(own)
            if size >= GATHERED:
                yield flush(found, counts)
                found, counts, size = [], [], 0
        if found:
            yield flush(found, counts)

    return run


def _often(least: int) -> Callable:
    """The hashes of a bucket whose counts reach the least one."""

    def run(table: pa.Table) -> pa.Table:
        (h, f), _ = gathered(table, 0, HASHED)
        h, which = np.unique(h, return_inverse=True)
        return pa.table({"hash": h[np.bincount(which, f) >= least].astype(np.int64)})

    return run


def _strings(wanted: Callable, longest: int, parts: int) -> Callable:
    """Packed counts of the phrases that a filter holds, with their strings, and all words of each lang with n = 0."""

    def flush(found: list[tuple], names: list[str]) -> pa.RecordBatch:
        h, n, lang, f = (np.concatenate([x[k] for x in found]) for k in range(4))
        text = pa.chunked_array([x[4] for x in found]).combine_chunks()
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        f = np.bincount(which, f).astype(np.int64)
        part = (h[first] >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        first, f, part = first[order], f[order], part[order]
        bounds = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)) if len(part) else np.zeros(1, np.int64)
        data = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            k = first[a:b]
            own = text.take(pa.array(k))
            ends = np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1]
            tag = "\0".join(names).encode()
            payload = len(tag).to_bytes(4, "little") + tag + bytes(memoryview(own.buffers()[2] or b"")[: ends[-1]])
            data.append(pack([n[k], lang[k], f[a:b], np.diff(ends)], STRING, payload))
        return pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]].astype(np.int32)), pa.array([0] * len(data), pa.int32()), pa.array(data, pa.binary())], schema=SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted()
        found: list[tuple] = []
        total: dict[str, int] = {}
        size, names = 0, []
        for w, names in _worded(batches):
            for lang, k in zip(*np.unique(w.lang, return_counts=True), strict=True):
                total[names[lang]] = total.get(names[lang], 0) + int(k)
            for n, h, whole in w.hashes(longest):
                at = np.flatnonzero(whole & _has(bits, h))
                own, first, f = np.unique(h[at], return_index=True, return_counts=True)
                at = at[first]
                found.append((own, np.full(len(own), n), w.lang[at], f, w.phrases(at, n)))
                size += len(own)
            if size >= GATHERED:
                yield flush(found, names)
                found, size = [], 0
        if total:
            own = [names.index(x) for x in total]
            found.append((np.array([_seed(x) for x in total], np.uint64), np.zeros(len(own), int), np.array(own), np.array(list(total.values())), pa.array([""] * len(own), pa.large_string())))
            yield flush(found, names)

    return run


def _summed(least: int) -> Callable:
    """The strings of a bucket with their counts, from the least one on."""

    def run(table: pa.Table) -> pa.Table:
        total: dict[tuple[str, int, bytes], int] = {}
        for d in table["data"]:
            (n, lang, f, size), payload = unpack(d.as_py(), STRING)
            tag = 4 + int.from_bytes(payload[:4], "little")
            names, at, text = bytes(payload[4:tag]).decode().split("\0"), 0, bytes(payload[tag:])
            for k, x, c, m in zip(n.tolist(), lang.tolist(), f.tolist(), size.tolist(), strict=True):
                key = names[x], k, text[at : at + m]
                total[key] = total.get(key, 0) + c
                at += m
        kept = [(*k, f) for k, f in total.items() if f >= least or k[1] == 0]
        lang, n, phrase, f = zip(*kept, strict=True) if kept else ((), (), (), ())
        return pa.table([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array([x.decode() for x in phrase], pa.string()), pa.array(f, pa.int64())], names=["lang", "n", "phrase", "f"])

    return run


def _filter(hashes: DataFrame, filter_bits: int) -> Callable[[], np.ndarray]:
    """A handle of the bit filter of hashes(hash); one value of fixed size goes through the driver."""
    slot = F.shiftrightunsigned("hash", 64 - filter_bits)
    found = hashes.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bits = np.zeros(1 << (filter_bits - 6), np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint64)
    sent = hashes.sparkSession.sparkContext.broadcast(bits)
    return lambda: sent.value


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sampled: int = SAMPLED, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, n (words), phrase and f of every phrase of up to `longest` words (4 at most) with f >= least; and for each lang, with n = 0, all its words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    parts = buckets(texts.agg(F.sum(F.octet_length("text"))).first()[0])

    def found(part: DataFrame, name: str, at_least: int, now: Callable | None = None, before: Callable | None = None) -> DataFrame:
        counts = part.mapInArrow(_hashed(now, before, longest, parts), PACKED)
        return materialize(counts.groupBy("part").applyInArrow(_often(at_least), "hash long"), name)

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(sampled)) == 0)
    proposed = found(sample, "phrases-proposed", max(2, least // (2 * sampled)) if sampled > 1 else least)
    now = _filter(proposed, filter_bits)
    every = fresh = found(texts, "phrases-found", least, now)
    while True:
        # The two lowest bits tell the number of words; the longest phrases have no extensions to follow.
        failed = fresh.where(F.col("hash").bitwiseAND(3) < longest - 1).join(proposed, "hash", "left_anti")
        if not failed.limit(1).count():
            break
        proposed = materialize(proposed.unionByName(failed), "phrases-proposed")
        before, now = now, _filter(proposed, filter_bits)
        fresh = found(texts, "phrases-found", least, now, before)
        every = every.unionByName(fresh)
    strings = texts.mapInArrow(_strings(_filter(every, filter_bits), longest, parts), PACKED)
    return materialize(strings.groupBy("part").applyInArrow(_summed(least), COUNTS), "phrases-counted")


def _wide(c: Column | str) -> Column:
    return F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each lang by the score of their weakest cut, without those that a longer one stands for."""
    every = frequent(docs, least, longest)
    known = every.where(F.col("n") > 0)
    long_ = known.where(F.col("n") > 1).withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " ", -1))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = long_.select("lang", "phrase", "n", "w", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("rest"))
    left, right = (known.select("lang", F.col("phrase").alias(p), F.col("f").alias(f)) for p, f in (("head", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    # Both sides of the division are decimals: the product takes at most 26 digits, the sum 20.
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = long_.where(F.col("n") > 2).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
    inside = inside.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1))).select("lang", part(F.col("s"), F.col("m")).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * NEARLY))
    words = every.where(F.col("n") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
