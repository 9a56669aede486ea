"""Exact Jaccard self-join of shingle sets by a partition of the universe (pigeonhole), and its components.

Sets are taken by bands of size, each at most 4/3 of the one below, so linked sets lie in one band or in neighbours. For
a pair of neighbouring bands, the universe of shingles is dealt by hash into m segments. Linked sets differ in at most
H = floor((size + size) / 7) shingles, so

- with m = H + 1 + c segments, they agree in at least c + 1. An empty segment tells nothing and is no signature: a set of
  size s with `full` segments that are not empty, which differs from its partners in at most h(s) shingles, agrees with each in
  full - h(s) of those. So it may leave out all but h(s) + 1 of them, the commonest first (counted over the whole table, ties
  by hash), and still shares one with every set that it links to;
- with m = ceil((H + 1) / 2) segments, they agree in one up to one shingle, so they share a segment or a segment less
  one shingle (its one-deletion neighbourhood); segments of fewer than two shingles tell nothing here, and a set needs more of
  the others than h(s) / 2.

A set whose shingles fall into too few segments for that is dealt again by another hash, and again, up to LEVELS times. Two
linked sets both have the signatures of the first dealing that is good enough for one of them, and so share one. Sets
for which no dealing is good enough (a few in 10^15 of three shingles) share one signature.

Which of the two a band uses is set by its estimated cost from the number of sets in it: signatures written, and
candidates expected; deletion neighbourhoods are for small sets, where they stay short. Sets are deduplicated first;
signatures travel as packed numpy records, and a signature that only one set has goes at once. Sets that share a
kept signature form families; in a family, sets are compared exactly on bit sets of the shingles that recur in it, in
blocks, and only a spanning forest of the links leaves the task. No list of pairs is ever made.

Shingles, signatures and sets are known by 64-bit hashes.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer than five words
has its whole word sequence as one shingle; repeated rows and ids are in one component if their sets agree; a null
doc_id takes part but never names a component unless all its members are null; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialize, quoted
from .components import components
from .tokens import release, slices

WORDS = 5
BLOCK, SMALL = 2_048, 24
#: Dealings that a set is given to fill enough segments.
LEVELS = 16
#: Least and most bits, as powers of two, of the filter that finds candidates' rows before their texts are shuffled.
FILTER_BITS = (16, 28)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

SIGNATURE = np.dtype([("key", "<u4"), ("group", "u1"), ("spare", "<u2"), ("set", "<i8")])
MEMBER = np.dtype([("set", "<i8"), ("group", "u1"), ("spare", "<u2"), ("sig", "<u8"), ("count", "<u4")])
KEPT = np.dtype([("sig", "<u8"), ("set", "<i8")])


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text. bytes.lower() and split() know ASCII only, as the contract asks."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if len(h) < WORDS:
        out = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            out = _mix(out * _ODD[1] + h[k : k + 1] * _ODD[k])
        return out
    n = len(h) - WORDS + 1
    total = h[:n] * _ODD[0]
    for k in range(1, WORDS):
        total = _mix(total) + h[k : k + n] * _ODD[k]
    return np.unique(_mix(total))


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def edges_of_bands(most: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 4 // 3)))
    return out


EDGES = np.array(edges_of_bands(), np.int64)


def band(size: np.ndarray | int) -> np.ndarray:
    return np.searchsorted(EDGES, size, side="right") - 1


def most_apart(group: int) -> int:
    """H of a group: a set of its lower band and one of at most 4/3 its size."""
    s = int(EDGES[group + 1]) - 1
    return (s + min(int(EDGES[group + 2]) - 1, 4 * s // 3)) // 7


def allocate(sets_in_band: dict[int, int], recurring: float = 0.2, per_candidate: float = 1e-3) -> dict[int, tuple[int, int, bool]]:
    """For each group of bands (its lower one): segments, segments that a set may leave out, deletion neighbourhoods.

    recurring estimates the share of shingles that other texts have too: a segment of s shingles is shared by chance
    with a probability of its sth power. The choice only affects the cost.
    """
    out = {}
    for g in {b for k in sets_in_band for b in (k, k - 1) if b >= 0}:
        h, size = most_apart(g), int(EDGES[g + 1])
        sets = sets_in_band.get(g, 0) + sets_in_band.get(g + 1, 0)
        spare = (h + 1) // 2
        equal, deletion = h + 1 + spare, (h + 2) // 2
        by_equal = equal * (1 + sets * per_candidate * recurring ** (size / equal))
        by_deletion = (deletion + size) * (1 + sets * per_candidate * recurring ** (size / deletion - 1))
        use = h > 0 and size <= SMALL and by_deletion < by_equal
        out[g] = (deletion, 0, True) if use else (equal, spare, False)
    return out


def apart(size: np.ndarray, group: int) -> np.ndarray:
    """h(s): the shingles in which a set of a group and one that links to it differ at most."""
    return (size + np.minimum(int(EDGES[group + 2]) - 1, 4 * size // 3)) // 7


def signatures(sets: list[np.ndarray], names: np.ndarray, plan: dict[int, tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes and records (without the key) of all sets in both groups of their bands."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bands, sigs, recs = band(sizes), [], []

    def add(sig: np.ndarray, group: int, who: np.ndarray, spare: np.ndarray) -> None:
        rec = np.zeros(len(sig), SIGNATURE)
        rec["group"], rec["set"], rec["spare"] = group, names[who], np.minimum(spare, 65_535)
        sigs.append(sig)
        recs.append(rec)

    for g in {int(b) - d for b in np.unique(bands) for d in (0, 1) if b >= d}:
        segments, _, deletions = plan[g]
        own = np.flatnonzero((bands == g) | (bands == g + 1))
        for level in range(LEVELS):
            flat = np.concatenate([sets[k] for k in own])
            row = np.repeat(np.arange(len(own)), sizes[own])
            dealt = _mix(flat ^ np.uint64((g + 1) * 0x9E37 + (level << 32))) >> np.uint64(8)
            place = row * segments + (dealt % np.uint64(segments)).astype(np.int64)
            weight = _mix(flat + _ODD[2])
            order = np.argsort(place, kind="stable")
            at, first, filled = np.unique(place[order], return_index=True, return_counts=True)
            total = np.add.reduceat(weight[order], first)
            h = apart(sizes[own], g)
            full = np.bincount((at if not deletions else at[filled > 1]) // segments, minlength=len(own))
            good = full > (h // 2 if deletions else h)
            spare = np.where(good, full - h - 1, 0) if not deletions else np.zeros(len(own), np.int64)
            salt = lambda p: (p % segments + 1).astype(np.uint64) * _ODD[3] + np.array([g + (level << 8)], np.uint64) * _ODD[4]  # noqa: B023, E731
            add(_mix(total + salt(at)), g, own[at // segments], spare[at // segments])
            if deletions:
                size, sums = np.zeros(len(own) * segments, np.int64), np.zeros(len(own) * segments, np.uint64)
                size[at], sums[at] = filled, total
                more = size[place] > 1
                add(_mix(sums[place[more]] - weight[more] + salt(place[more])), g, own[row[more]], np.zeros(int(more.sum()), np.int64))
            own = own[~good]
            if not len(own):
                break
        else:
            add(np.full(len(own), _mix(np.array([g], np.uint64))[0]), g, own, np.zeros(len(own), np.int64))
    if not sigs:
        return np.empty(0, np.uint64), np.empty(0, SIGNATURE)
    return np.concatenate(sigs), np.concatenate(recs)


def _blobs(buckets: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """Records as one blob for each bucket."""
    order = np.argsort(buckets, kind="stable")
    names, first = np.unique(buckets[order], return_index=True)
    parts = np.split(records[order], first[1:]) if len(names) else []
    return pa.RecordBatch.from_arrays([pa.array(names.astype("i4"), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "records"])


def _joined(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table["records"]])


BLOBS = "bucket int, records binary"


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, n and set name of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in slices(batches):
            sets = [shingles(r["text"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["row"] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "row", "n", "set"])

    return docs.mapInArrow(run, "doc_id long, row long, n long, set long")


def families(docs: DataFrame, plan: dict[int, tuple[int, int, bool]], buckets: int) -> DataFrame:
    """Candidates: a and b of one family, as a forest over sets that share a kept signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sigs, recs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            s, r = np.concatenate(sigs), np.concatenate(recs)
            r["key"] = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            return _blobs((s >> np.uint64(32)) % np.uint64(buckets), r)

        for rows in slices(batches):
            sets = {}
            for r in rows:
                if len(s := shingles(r["text"])):
                    sets[set_id(s)] = s
            s, r = signatures(list(sets.values()), np.array(list(sets), np.int64), plan)
            sigs.append(s)
            recs.append(r)
            held += len(s)
            if held > 1_500_000:
                yield flush()
                sigs, recs, held = [], [], 0
        if held:
            yield flush()

    def shared(table: pa.Table) -> pa.Table:
        """Signatures that two sets or more have, with their counts, dealt by set."""
        r = _joined(table, SIGNATURE)
        r = r[np.lexsort((r["set"], r["group"], r["key"]))]
        new_sig = np.ones(len(r), bool)
        new_sig[1:] = (r["key"][1:] != r["key"][:-1]) | (r["group"][1:] != r["group"][:-1])
        fresh = new_sig.copy()
        fresh[1:] |= r["set"][1:] != r["set"][:-1]
        r, new_sig = r[fresh], None
        starts = np.ones(len(r), bool)
        starts[1:] = (r["key"][1:] != r["key"][:-1]) | (r["group"][1:] != r["group"][:-1])
        first = np.flatnonzero(starts)
        count = np.diff(np.append(first, len(r)))
        count = np.repeat(count, count)
        r, count = r[count > 1], count[count > 1]
        out = np.zeros(len(r), MEMBER)
        out["set"], out["group"], out["spare"], out["count"] = r["set"], r["group"], r["spare"], count
        # A deletion neighbourhood's bucket and key may meet another group's; the group keeps them apart.
        out["sig"] = _mix(r["key"].astype(np.uint64) + (np.uint64(table["bucket"][0].as_py()) << np.uint64(32)) + r["group"] * _ODD[0])
        return pa.Table.from_batches([_blobs(r["set"].astype(np.uint64) % np.uint64(buckets), out)])

    def spare(table: pa.Table) -> pa.Table:
        """Each set leaves out its commonest signatures, as many as it may; dealt by signature. Dealings that were not good enough spare none."""
        r = _joined(table, MEMBER)
        r = r[np.lexsort((r["sig"], r["count"], r["spare"], r["group"], r["set"]))]
        starts = np.ones(len(r), bool)
        starts[1:] = (r["set"][1:] != r["set"][:-1]) | (r["group"][1:] != r["group"][:-1]) | (r["spare"][1:] != r["spare"][:-1])
        first = np.flatnonzero(starts)
        size = np.diff(np.append(first, len(r)))
        left = size - r["spare"][first].astype(np.int64)
        keep = np.arange(len(r)) - np.repeat(first, size) < np.repeat(left, size)
        out = np.zeros(int(keep.sum()), KEPT)
        out["sig"], out["set"] = r["sig"][keep], r["set"][keep]
        return pa.Table.from_batches([_blobs(out["sig"] % np.uint64(fewer), out)])

    def linked(table: pa.Table) -> pa.Table:
        """A forest over the sets of each kept signature."""
        r = _joined(table, KEPT)
        r = r[np.lexsort((r["set"], r["sig"]))]
        same = r["sig"][1:] == r["sig"][:-1]
        a, b = r["set"][:-1][same], r["set"][1:][same]
        a, b = forest(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    fewer = max(16, buckets // 16)  # few signatures are kept, and the more of them a task has, the fewer edges leave it
    own = docs.mapInArrow(sign, BLOBS)
    own = own.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared, BLOBS)
    own = own.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(spare, BLOBS)
    return own.repartition(fewer, "bucket").groupBy("bucket").applyInArrow(linked, "a long, b long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) of a spanning forest of the edges a-b."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[child]], nodes[child]


def compare(sets: list[np.ndarray], names: np.ndarray, percent: int, side: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links between sets, as a forest: pairs that are in one tree already are not compared.

    side: if given, only sets of different sides are compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    universe, slot, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(seen > 1) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    common = seen[slot] > 1
    width = max(1, -(-int((seen > 1).sum()) // 64))
    bits = np.zeros((len(sets), width), np.uint64)
    at = column[slot[common]]
    np.bitwise_or.at(bits, (row[common], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    # The sets with most shingles in common with others first: they tie a family together soonest.
    order = np.argsort(-np.bincount(row[common], weights=seen[slot[common]], minlength=len(sets)) / np.maximum(sizes, 1), kind="stable")
    bits, sizes, names = bits[order], sizes[order], names[order]
    side = side[order] if side is not None else None
    label = np.arange(len(sets))
    a, b = [], []
    for i in range(len(sets) - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[(100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i]))]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        both = np.concatenate([np.bitwise_count(bits[part] & bits[i]).sum(1, dtype=np.int64) for part in np.array_split(j, max(1, len(j) * width // 2_000_000))])
        for k in j[100 * both >= percent * (sizes[j] + sizes[i] - both)]:
            if label[k] != label[i]:
                a.append(int(names[i]))
                b.append(int(names[k]))
                label[label == label[k]] = label[i]
    return a, b


def bit_filter(keys: DataFrame, place: Callable[[int], Column]) -> tuple[int, np.ndarray]:
    """A Bloom filter with one hash: its number of bits, and the bitmap as 64-bit words. At most 2**28 bits, however many keys."""
    count = keys.count()
    bits = 1 << min(max(math.ceil(math.log2(16 * count + 1)), FILTER_BITS[0]), FILTER_BITS[1])
    at = keys.select(place(bits).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits, out


def join(docs: DataFrame, percent: int = 75, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    out = rooted(docs, percent, block, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def rooted(docs: DataFrame, percent: int = 75, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """doc_id, row, n, root and component_id of every row: root names the component by a set and is null for an empty set.

    row is a long that tells rows apart, of any id; where it is not given, rows without an id are known by their texts.
    """
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    own = docs.select(id_.alias("doc_id"), text.alias("text"), (F.when(id_.isNull(), F.xxhash64(text)) if row is None else row).alias("row"))
    if percent < 75:
        raise ValueError("bands and segments hold for a similarity of 0.75 or more")
    members = materialize(sets_of(own), "jaccard-sets")
    sizes = members.where("n > 0").groupBy("n").agg(F.approx_count_distinct("set").alias("sets"), F.count(F.lit(1)).alias("rows")).collect()  # a row for each size that occurs
    in_band: dict[int, int] = {}
    for r in sizes:
        in_band[int(band(r.n))] = in_band.get(int(band(r.n)), 0) + r.sets
    plan = allocate(in_band)
    written = sum(r.rows * sum(plan[g][0] for g in (int(band(r.n)), int(band(r.n)) - 1) if g >= 0) for r in sizes)
    buckets = max(16, written // 1_000_000)
    forest_edges = materialize(families(own, plan, buckets), "jaccard-candidates")
    family = components(forest_edges).select(F.col("v").alias("set"), F.col("root").alias("family"))

    # One row of each candidate set gives its shingles: by its id, or, where all rows of the set lack one, by its row key.
    key = lambda: F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", "row").alias("key"))
    one = members.where("n > 0").groupBy("set").agg(F.min(key()).alias("at")).join(family, "set")
    count = one.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    one = materialize(one.join(count, "family").select("at.*", "set", "family", "size"), "jaccard-families")
    wanted = one.select("no_id", "key", "set", "family", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    place = lambda bits: F.pmod(F.xxhash64("no_id", "key"), F.lit(bits))
    bits, bitmap = bit_filter(wanted, place)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)  # of at most 2**28 bits

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose bit is set. Rows of one id or text may be many; a task sends each of them once."""
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            at = batch["at"].to_numpy()
            batch = batch.filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1))
            keep = []
            for k, (no_id, key, text) in enumerate(zip(batch["no_id"].to_pylist(), batch["key"].to_pylist(), batch["text"], strict=True)):
                h = xxhash.xxh3_64_intdigest(f"{no_id} {key} ".encode() + bytes(text.as_buffer()))
                if h not in seen:
                    seen.add(h)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select(["no_id", "key", "text"])

    texts = own.where("text is not null").select(key().alias("k"), "text").select("k.*", "text").withColumn("at", place(bits))
    texts = texts.mapInArrow(candidates, "no_id boolean, key long, text string")
    # Only candidates' rows are left, and few others; the filter's errors end in this join, other texts of an id in verify.
    loaded = texts.join(wanted.hint("shuffle_merge"), ["no_id", "key"]).select("family", "set", "blocks", "text")
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    loaded = loaded.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    loaded = loaded.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", "blocks")

    def verify(table: pa.Table) -> pa.Table:
        found: dict[int, tuple[np.ndarray, int]] = {}
        for name, text, part in zip(table["set"].to_pylist(), table["text"], table["mine"].to_pylist(), strict=True):
            if name not in found and len(s := shingles(text.as_py())) and set_id(s) == name:
                found[name] = (s, part)
        names = np.array(sorted(found), np.int64)
        sets, side = [found[int(n)][0] for n in names], np.array([found[int(n)][1] for n in names])
        a, b = compare(sets, names, percent, side if table["i"][0] != table["j"][0] else None) if len(sets) > 1 else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = materialize(loaded.groupBy("family", "i", "j").applyInArrow(verify, "a long, b long"), "jaccard-links")
    roots = components(links)
    named = members.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    named = named.join(roots, named["set"] == roots.v, "left").select("set", F.coalesce("root", "set").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("set", "root", "component_id")
    return members.join(named, "set", "left").select("doc_id", "row", "n", "root", "component_id")


def deduplicate(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of docs, with its own columns: of the least id (rows without one come last), then of the least row key.

    A row without words stands for itself, but rows of one id that are wholly alike are one document. Rows to drop or to
    fold are found by a bit filter first, so that only they, and the few that the filter mistakes, are shuffled.
    """
    columns = docs.columns
    key, hit, keep = (fresh(columns, c) for c in ("row", "hit", "keep"))
    row = F.xxhash64(*[quoted(c) for c in columns], *[quoted(c).isNull() for c in columns])  # the hash alone passes over nulls
    per = rooted(docs, percent, id_col=id_col, text_col=text_col, row=row).groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies"))
    per = materialize(per, "dedup-rows")
    first = per.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("r")).select("root", F.col("r.row").alias("first"))
    grouped = per.join(first, "root").where("row <> first or copies > 1").select(F.col("row").alias(key), (F.col("row") == F.col("first")).alias(keep))
    blank = per.where("root is null and doc_id is not null and copies > 1").select(F.col("row").alias(key), F.lit(True).alias(keep))
    special = materialize(grouped.unionByName(blank), "dedup-special")
    place = lambda bits: F.pmod(F.xxhash64(key), F.lit(bits))
    bits, bitmap = bit_filter(special, place)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)  # of at most 2**28 bits

    @F.arrow_udf("boolean")
    def marked(at: pa.Array) -> pa.Array:
        x = at.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[x >> 6] >> (x & 63)) & 1 == 1)

    alone = F.col(id_col).isNull() & (F.trim(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(SPACE)) == "")
    own = docs.withColumn(key, row).withColumn(hit, marked(place(bits)) & ~alone)
    columns = [quoted(c) for c in columns]
    # A row key that occurs twice is among the special ones, so folding loses nothing of the rows met by mistake.
    met = own.where(hit).dropDuplicates([key]).join(special.hint("shuffle_merge"), key, "left").where(F.coalesce(keep, F.lit(True)))
    return own.where(~F.col(hit)).select(*columns).unionByName(met.select(*columns))
