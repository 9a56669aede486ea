"""Repeated text by suffix order: a byte goes if a string of `length` bytes that covers it also starts earlier.

What is looked for is LPF >= length, where LPF (longest previous factor) of a place is the longest string that starts there
and also starts earlier. It comes from the suffix array: among the suffixes in order, the nearest ones to the left and to the
right whose place is earlier (previous and next smaller place) have the longest common prefixes with it. One array over a
corpus would be one task's work, so suffixes are dealt out by content such that all that agree on `length` bytes meet:

1. In every window of `length` bytes, the least hash of its 24-byte pieces is the window's anchor, the same one wherever the
   window stands. The windows that share an anchor form one context of at most 2 * length - 24 bytes. Contexts meet by their
   anchor's hash; of contexts that are alike (128 bits of hash) the earliest stands for the others, whose windows have all been met before.
2. Contexts that share an anchor but differ are fetched from their texts, and each bucket of anchors sorts all suffixes that
   start in them, finds previous and next smaller places, and so the LPF of each suffix, up to `length`.
3. The windows found are joined to spans and cut out of the texts.

Entries travel packed by bucket, a compressed row for each task and bucket. An anchor that holds more than a set share of
a sample of the texts would fill its bucket: its contexts are dealt out by the whole context, and in step 2 window by
window, which changes no result. There are at most 1 / MOST_SHARE such anchors.

Defined results: null text is empty; places are ordered by doc_id (null first), then by a 64-bit hash of the text, then by
offset. Of rows that agree in id and text one, and no matter which, is the earliest. An empty table gives an empty table.
Columns other than doc_id and text are not read. Very long texts are read in blocks of 1 MB.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .packed import ODD, PACKED, SCHEMA, Columns, buckets, gathered, mixed, pack, packed_rows, unpack

LENGTH = 100
#: Bytes of a piece whose hash may be a window's anchor.
PIECE = 24
#: Bytes of text that are hashed at once, and the bits that hold a place among twice as many.
BLOCK, BLOCK_BITS = 1_000_000, 21
#: Anchors that a task gathers before it packs them.
GATHERED = 400_000
#: Texts of one in so many hash values are read for frequent anchors, and the least share and number of those.
SAMPLED, MOST_SHARE, LEAST_SEEN = 16, 1e-5, 64
#: Suffixes that are compared byte by byte at once.
ROWS = 200_000

ANCHORS, SPANS, WANTED, TEXTS, CONTEXTS = range(5)
ANCHOR = ("<u8", "<u8", "<i8", "<i8", "<u4", "u1")  # hash, context's hash, doc, tie, start, windows less one
SPAN = ("<i8", "<i8", "<u4", "<u4")  # doc, tie, start, bytes
WANT = ("<u8", "<i8", "<i8", "<u4", "u1", "u1")  # hash, doc, tie, start, windows less one, frequent
TEXT = ("<i8", "<i8", "u1", "<u4")  # doc, tie, id is null, bytes
CONTEXT = ("<i8", "<i8", "<u4", "u1")  # doc, tie, start, windows less one
RESULT = "doc_id long, spans array<struct<start:long,bytes:long>>, kept binary"


def _home(doc: np.ndarray, tie: np.ndarray, parts: int) -> np.ndarray:
    """The part in which a text meets what is known about it."""
    return mixed(doc, tie) % np.uint64(parts)


def _level(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of strings of twice the length, from those of two halves."""
    x = h[:-step] * ODD[0]
    x ^= x >> np.uint64(29)
    x += h[step:]
    x *= ODD[2]
    x ^= x >> np.uint64(32)
    return x


def anchors(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the texts that stand one after another in data: anchor's hash, context's hash, start and windows less one.

    length must be 32 at least.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    h, n, levels = (data.astype(np.uint64) + np.uint64(1)) * ODD[1], 1, {}
    while n * 2 <= length:
        h, n = _level(h, n), n * 2
        levels = {k: v for k, v in levels.items() if k in (PIECE - 16, 16)} | {n: h}
    piece = mixed(levels[16][: len(data) - PIECE + 1], levels[PIECE - 16][16 : len(data) - PIECE + 17])
    low = np.uint64(BLOCK_BITS)
    least = (piece >> low << low) | np.arange(len(piece), dtype=np.uint64)
    wide, n = length - PIECE + 1, 1
    while n * 2 <= wide:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < wide:
        least = np.minimum(least[: len(least) - (wide - n)], least[wide - n :])
    end = np.repeat(np.cumsum(sizes), sizes)
    start = np.flatnonzero(np.arange(len(least)) + length <= end[: len(least)])
    at = (least[start] & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    if not len(first):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    begin, last = start[first], start[np.append(first[1:], len(start)) - 1]
    top = max(levels)
    whole = lambda q: mixed(levels[top][q], levels[top][q + length - top])
    return piece[at[first]], mixed(whole(begin), whole(last), last - begin, at[first] - begin), begin, last - begin


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, tie, offsets and bytes of a batch."""
    text = batch.column("text").cast(pa.large_binary())
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    return batch.column("doc").to_numpy(), batch.column("tie").to_numpy(), bounds, data


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc, tie, start in the text, size and bytes of pieces of texts; each window of a text lies whole in one piece."""
    for batch in batches:
        doc, tie, bounds, data = _texts(batch)
        rows: list[tuple[int, int, int]] = []
        total = 0
        for k in range(len(doc)):
            for a in range(int(bounds[k]), max(int(bounds[k + 1]) - length + 1, int(bounds[k])), BLOCK):
                b = min(a + BLOCK + length - 1, int(bounds[k + 1]))
                rows.append((k, a, b))
                total += b - a
                if total >= BLOCK:
                    yield _block(rows, doc, tie, bounds, data)
                    rows, total = [], 0
        if rows:
            yield _block(rows, doc, tie, bounds, data)


def _block(rows: list, doc: np.ndarray, tie: np.ndarray, bounds: np.ndarray, data: np.ndarray) -> tuple:
    k, a, b = (np.array(x) for x in zip(*rows, strict=True))
    return doc[k], tie[k], a - bounds[k], b - a, np.concatenate([data[x:y] for _, x, y in rows])


def _frequent(length: int) -> Callable:
    """Counts of the anchors' hashes in a sample, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [anchors(data, size, length)[0] for _, _, _, size, data in _blocks(batches, length)]
        hashes, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = counts >= 4  # of a task's texts; what is rarer everywhere fills no bucket
        yield pa.RecordBatch.from_arrays([pa.array(hashes[often].astype(np.int64)), pa.array(counts[often]), pa.array(np.full(often.sum(), 0, np.int64))], names=["hash", "n", "anchors"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["hash", "n", "anchors"])

    return run


def _anchored(parts: int, frequent: np.ndarray, length: int) -> Callable:
    def flush(own: list[Columns]) -> Iterator[pa.RecordBatch]:
        h, c, doc, tie, start, more = (np.concatenate(x) for x in zip(*own, strict=True))
        # Contexts met more than once in this task: only the earliest goes on, the others are spans already.
        both = mixed(h, c)
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        again = np.zeros(len(order), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        alike = np.flatnonzero(again)
        later = alike[_later(*(x[alike] for x in (h, c, doc, tie, start)))]
        yield packed_rows(_home(doc[later], tie[later], parts), SPANS, [doc[later], tie[later], start[later], more[later] + length], SPAN)
        keep = np.ones(len(h), bool)
        keep[later] = False
        h, c, doc, tie, start, more = (x[keep] for x in (h, c, doc, tie, start, more))
        part = np.where(np.isin(h, frequent), mixed(h, c), mixed(h)) % np.uint64(parts)
        yield packed_rows(part, ANCHORS, [h, c, doc, tie, start, more], ANCHOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Columns] = []
        n = 0
        for doc, tie, base, size, data in _blocks(batches, length):
            h, c, start, more = anchors(data, size, length)
            begin = np.cumsum(size) - size
            which = np.searchsorted(begin, start, "right") - 1
            own.append([h, c, doc[which], tie[which], start - begin[which] + base[which], more])
            n += len(h)
            if n >= GATHERED:
                yield from flush(own)
                own, n = [], 0
        if own:
            yield from flush(own)

    return run


def _later(h: np.ndarray, c: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The rows whose context (h, c) also stands at an earlier place."""
    order = np.lexsort((start, tie, doc, c, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return order[(doc[first] != doc[order]) | (tie[first] != tie[order]) | (start[first] != start[order])]


def _passed(table: pa.Table) -> pa.Table:
    """Spans that are addressed to this part already."""
    return table.filter(pc.equal(table["kind"], SPANS)).select(["part", "kind", "data"])


def _classes(parts: int, frequent: np.ndarray, length: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        (h, c, doc, tie, start, more), _ = gathered(table, ANCHORS, ANCHOR)
        later = _later(h, c, doc, tie, start)
        out = [packed_rows(_home(doc[later], tie[later], parts), SPANS, [doc[later], tie[later], start[later], more[later].astype(np.uint32) + length], SPAN)]
        keep = np.ones(len(h), bool)
        keep[later] = False
        h, c, doc, tie, start, more = (x[keep] for x in (h, c, doc, tie, start, more))
        often = np.isin(h, frequent)
        _, which, count = np.unique(h, return_inverse=True, return_counts=True)
        rest = (count[which] > 1) | often
        cols = [x[rest] for x in (h, doc, tie, start, more, often)]
        out.append(packed_rows(_home(cols[1], cols[2], parts), WANTED, cols, WANT))
        return pa.concat_tables([pa.Table.from_batches(out, SCHEMA), _passed(table).cast(SCHEMA)])

    return run


def _packed_texts(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie, bounds, data = _texts(batch)
            none, part = batch.column("none").to_numpy(zero_copy_only=False), _home(doc, tie, parts)
            for p in np.unique(part):
                k = np.flatnonzero(part == p)
                payload = b"".join(data[bounds[i] : bounds[i + 1]].tobytes() for i in k)
                own = pack([doc[k], tie[k], none[k], bounds[k + 1] - bounds[k]], TEXT, payload)
                yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([TEXTS], pa.int32()), pa.array([own], pa.binary())], schema=SCHEMA)

    return run


def _places(table: pa.Table) -> tuple[dict[tuple[int, int], memoryview], list[tuple[int, int, int, memoryview]]]:
    """The texts of a part by doc and tie, and one by one."""
    by, rows = {}, []
    for k, d in zip(table["kind"].to_pylist(), table["data"], strict=True):
        if k != TEXTS:
            continue
        (doc, tie, none, size), payload = unpack(d.as_py(), TEXT)
        at = 0
        for row in zip(doc.tolist(), tie.tolist(), none.tolist(), size.tolist(), strict=True):
            own = payload[at : at + row[3]]
            at += row[3]
            rows.append((*row[:3], own))
            by[row[:2]] = own
    return by, rows


def _fetched(parts: int, length: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        (h, doc, tie, start, more, often), _ = gathered(table, WANTED, WANT)
        texts, _ = _places(table)
        part = (mixed(h) % np.uint64(parts)).tolist()
        own: dict[int, list] = {}
        least: dict[bytes, tuple[int, int, int]] = {}
        spans = []
        for p, d, t, s, m, f in zip(part, doc.tolist(), tie.tolist(), start.tolist(), more.tolist(), often.tolist(), strict=True):
            text = texts[d, t]
            if not f:
                own.setdefault(p, []).append((d, t, s, m, bytes(text[s : s + m + length])))
                continue
            for a in range(s, s + m + 1):  # a frequent anchor's windows go one by one, each once from a part
                window = bytes(text[a : a + length])
                first = least.setdefault(window, (d, t, a))
                if first != (d, t, a):
                    least[window], last = min(first, (d, t, a)), max(first, (d, t, a))
                    spans.append((*last, length))
        for window, (d, t, a) in least.items():
            own.setdefault(zlib.crc32(window) % parts, []).append((d, t, a, 0, window))
        out = []
        for p, rows in own.items():
            cols = [np.array(x) for x in list(zip(*(r[:4] for r in rows), strict=True))]
            out.append({"part": p, "kind": CONTEXTS, "data": pack(cols, CONTEXT, b"".join(r[4] for r in rows))})
        if spans:
            cols = [np.array(x) for x in zip(*spans, strict=True)]
            out += packed_rows(_home(cols[0], cols[1], parts), SPANS, cols, SPAN).to_pylist()
        return pa.Table.from_pylist(out, SCHEMA)

    return run


def smaller(place: np.ndarray, step: int) -> np.ndarray:
    """For each index the nearest one before it (step -1) or after it (step 1) whose place is smaller; -1 where none is.

    Between an index and the one that it points to, no place is smaller than its own; so where the one that it points to is
    not smaller either, it may point to where that one points.
    """
    n = len(place)
    to = np.arange(n) + step
    to[to == n] = -1
    left = np.flatnonzero(to >= 0)
    while len(left):
        left = left[place[to[left]] >= place[left]]
        to[left] = to[to[left]]
        left = left[to[left] >= 0]
    return to


def previous_factors(strings: np.ndarray, place: np.ndarray) -> np.ndarray:
    """LPF of each string (rows of bytes, all of one length) against those at smaller places, up to that length."""
    n, length = strings.shape
    order = np.lexsort((place, strings.view(f"S{length}").ravel())) if n else np.zeros(0, np.int64)
    ordered = place[order]
    out = np.zeros(n, np.int64)
    for step in (-1, 1):
        to = smaller(ordered, step)
        some = np.flatnonzero(to >= 0)
        for a in range(0, len(some), ROWS):
            k = some[a : a + ROWS]
            differ = strings[order[k]] != strings[order[to[k]]]
            common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
            out[order[k]] = np.maximum(out[order[k]], common)
    return out


def _factors(parts: int, length: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        (doc, tie, start, more), payloads = gathered(table, CONTEXTS, CONTEXT)
        passed = _passed(table).cast(SCHEMA)
        if not len(doc):
            return passed
        data = np.frombuffer(b"".join(payloads), np.uint8)
        more, start = more.astype(np.int64), start.astype(np.int64)
        size = more + length
        begin = np.cumsum(size) - size
        order = np.lexsort((tie, doc))
        unit = np.empty(len(doc), np.int64)
        unit[order] = np.cumsum(np.append(0, (doc[order][1:] != doc[order][:-1]) | (tie[order][1:] != tie[order][:-1])))
        which = np.repeat(np.arange(len(doc)), more + 1)
        step = np.arange(len(which)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        place = unit[which] << 32 | (start[which] + step)
        strings = np.lib.stride_tricks.sliding_window_view(data, length)[begin[which] + step]
        found = np.flatnonzero(previous_factors(strings, place) >= length)
        # Windows that follow one another make one span.
        new = np.ones(len(found), bool)
        new[1:] = (which[found][1:] != which[found][:-1]) | (np.diff(found) != 1)
        first = found[new]
        last = found[np.append(np.flatnonzero(new)[1:], len(found)) - 1] if len(found) else found
        k = which[first]
        own = packed_rows(_home(doc[k], tie[k], parts), SPANS, [doc[k], tie[k], start[k] + step[first], last - first + length], SPAN)
        return pa.concat_tables([pa.Table.from_batches([own], SCHEMA), passed])

    return run


def _merged(start: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Sorted disjoint spans (start, end) that do not touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), np.maximum.accumulate((start[order].astype(np.int64) + size[order]))
    new = np.append(True, start[1:] > end[:-1])
    return list(zip(start[new].tolist(), end[np.append(np.flatnonzero(new)[1:], len(start)) - 1].tolist(), strict=True))


def _removed(length: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        (doc, tie, start, size), _ = gathered(table, SPANS, SPAN)
        order = np.lexsort((tie, doc))
        doc, tie, start, size = (x[order] for x in (doc, tie, start, size))
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))) if len(doc) else np.zeros(0, np.int64)
        spans = {(int(doc[a]), int(tie[a])): (a, b) for a, b in zip(cut, np.append(cut[1:], len(doc)), strict=False)}  # of no spans there is an end and no start
        seen: set[tuple[int, int]] = set()
        out: tuple[list, list, list] = ([], [], [])
        for d, t, none, text in _places(table)[1]:
            if (d, t) in seen:
                own = [(0, len(text))] if len(text) >= length else []
            else:
                seen.add((d, t))
                a, b = spans.get((d, t), (0, 0))
                own = _merged(start[a:b], size[a:b]) if b > a else []
            at, kept = 0, []
            for a, b in own:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            out[0].append(None if none else d)
            out[1].append([{"start": a, "bytes": b - a} for a, b in own])
            out[2].append(b"".join(kept))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], pa.binary())], names=["doc_id", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, the spans of bytes that are repeats, and the remaining bytes, for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    total, ids, count, holes = rows.agg(F.sum(F.octet_length("text")), F.count_distinct("id"), F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    tie = F.lit(0).cast("long") if ids == count and not holes else F.xxhash64("text")
    rows = rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("doc"), tie.alias("tie"), F.col("id").isNull().cast("byte").alias("none"), "text")
    parts = buckets(total)
    sample = rows.where(F.pmod(F.xxhash64("doc", "tie", F.lit(12)), F.lit(SAMPLED)) == 0)
    counts = sample.mapInArrow(_frequent(length), "hash long, n long, anchors long")
    seen = counts.agg(F.sum("anchors")).first()[0] or 0
    least = max(LEAST_SEEN, math.ceil(max(MOST_SHARE, 1 / (8 * parts)) * seen))
    frequent = np.array([r[0] for r in counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()], np.int64).astype(np.uint64)

    met = rows.mapInArrow(_anchored(parts, frequent, length), PACKED).groupBy("part").applyInArrow(_classes(parts, frequent, length), PACKED)
    met = materialize(met, "repeats-met")
    texts = rows.mapInArrow(_packed_texts(parts), PACKED)
    fetched = texts.unionByName(met.where(F.col("kind") == WANTED)).groupBy("part").applyInArrow(_fetched(parts, length), PACKED)
    found = materialize(fetched.groupBy("part").applyInArrow(_factors(parts, length), PACKED), "repeats-found")
    spans = met.where(F.col("kind") == SPANS).unionByName(found)
    return texts.unionByName(spans).groupBy("part").applyInArrow(_removed(length), RESULT)
