"""Prefix trie of conversations: member intervals by range minima over the sorted conversations' common prefixes.

Conversations become sequences of turn names (a digest of role and text), equal ones are folded, and the distinct
sequences are dealt out in sorted order. In each partition the common prefixes of neighbours (LCP, in turns) go into a
sparse table; every prefix that a sequence is the first to have then searches the table to the left and to the right, by
halving steps, for the interval of sequences that share it. Members, leaves and saved characters are differences of
running sums, as nodes stand in preorder; no stack is kept. Prefixes that reach a partition's first or last sequence may
go on in the next partition: their partial rows, about two sequences' worth for each partition, are summed by node and
put together in one task.

Defined results: rows without conv_id take no part; null role or text is empty; turns are ordered by turn (null first), then
role, then text, so that repeated turns have one order; a repeated row is a further turn; an empty table has no nodes, not
even a root; columns beyond conv_id, turn, role and text are not read. The member list of a node's ends is hashed in
pieces, so that a conversation held by very many ids needs no long list in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Characters of a turn's name in a sequence's key: an MD5 digest in hexadecimal.
NAME = 32
#: Ids of one piece of a conversation's member list agree but for so many low bits.
PIECE_BITS = 16
#: Most turns that a conversation may take from the first of its hundred.
MOST_SHARED = 5

NODE = "kind string, node string, parent string, depth long, chars long, n_convs long, conv_id long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id with the names and lengths of its turns, in order, as one array of structs."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    name = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    turns = rows.select("conv_id", place.alias("place"), name.alias("name"), F.char_length("text").alias("chars"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "name", "chars"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation c with the first turns of conversation c - c % 100 in place of as many of its own.

    Their number is the unsigned crc32 of c in decimal, modulo 6.
    """
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("head"), F.slice("turns", 1, MOST_SHARED).alias("lead"))
    n = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED + 1)).cast("int")
    both = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % 100).withColumn("n", n).join(heads, "head", "left")
    kept = F.when(F.size("turns") > F.col("n"), F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    lead = F.when(F.col("lead").isNull() | (F.col("n") == 0), F.slice("turns", 1, 0)).otherwise(F.slice("lead", 1, F.greatest("n", F.lit(1))))
    return both.select("conv_id", F.concat(lead, kept).alias("turns"))


def trie(seqs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of sequences(conv_id, turns), with its members' figures.

    turns: array of structs with name (32 characters) and chars (the length that sharing the turn saves).
    """
    keyed = seqs.select("conv_id", F.array_join(F.transform("turns", lambda t: t["name"]), "").alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    folded = keyed.groupBy("key", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.first("chars").alias("chars"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    dealt = folded.repartitionByRange("key").sortWithinPartitions("key", "piece")
    nodes = materialize(dealt.mapInArrow(_nodes, NODE), "trie")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = nodes.where("kind = 'border'").groupBy("node", "parent", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"), *sums)
    border = materialize(border.repartition(1).mapInArrow(_joined, "node string, " + RESULT), "trie-border")
    inner = nodes.where("kind = 'inner'").join(border.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return inner.select(*COLUMNS).unionByName(border.select(*COLUMNS))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def minima(values: np.ndarray) -> list[np.ndarray]:
    """The sparse table: level j holds the least of every 2^j values from each place."""
    table = [values]
    while len(values) >= 2 << (len(table) - 1):
        last, step = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(last[:-step], last[step:]))
    return table


def extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place and depth, the first and last place that share a prefix of that depth with it.

    table holds the minima of lcp, where lcp[i] is the common prefix of places i - 1 and i. Either side is searched for
    itself: from the largest power of two down, a step is taken where all of lcp that it passes is deep enough.
    """
    left, right, n = at.copy(), at.copy(), len(table[0])
    for j in range(len(table) - 1, -1, -1):
        step = 1 << j
        ok = right + step < n
        ok[ok] = table[j][right[ok] + 1] >= depth[ok]
        right[ok] += step
        ok = left >= step
        ok[ok] = table[j][left[ok] - step + 1] >= depth[ok]
        left[ok] -= step
    return left, right


def least_in(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value of each range, by two overlapping powers of two."""
    out, level = np.empty(len(first), table[0].dtype), np.frexp(last - first + 1)[1] - 1
    for j in np.unique(level):
        k = level == j
        out[k] = np.minimum(table[j][first[k]], table[j][last[k] - (1 << int(j)) + 1])
    return out


def _shared(a: str, b: str) -> int:
    """Turns of the common prefix of two keys."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // NAME
    low, high = 0, n // NAME  # the first low turns agree, the first high + 1 do not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * NAME : mid * NAME] == b[low * NAME : mid * NAME] else (low, mid)
    return low


def _folded(batches: Iterator[pa.RecordBatch]) -> tuple[list, list, list, list, list]:
    """Keys in order, the lengths of their turns, and the number, least and hash of their members."""
    keys, chars, counts, least, hashes = [], [], [], [], []
    for batch in batches:
        ids, rows = batch.column("ids"), batch.select(["key", "chars"]).to_pylist()
        for k, row in enumerate(rows):
            own = ids[k].values.to_numpy()
            listed = ",".join(map(str, own.tolist())).encode()
            if keys and keys[-1] == row["key"]:
                counts[-1] += len(own)
                least[-1] = min(least[-1], int(own[0]))
                hashes[-1].update(b"," + listed)
            else:
                keys.append(row["key"])
                chars.append(row["chars"])
                counts.append(len(own))
                least.append(int(own[0]))
                hashes.append(hashlib.sha256(listed))
    return keys, chars, counts, least, [h.hexdigest() for h in hashes]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition's sequences: whole ones, and parts of those that may go on in another partition."""
    keys, chars, counts, least, hashes = _folded(batches)
    if not keys:
        return
    m = len(keys)
    size = np.array([len(k) // NAME for k in keys])
    lcp = np.array([0, *map(_shared, keys[:-1], keys[1:])])
    table, smallest = minima(lcp), minima(np.array(least))
    new = size - lcp  # prefixes that a sequence is the first to have
    start = np.concatenate([[0], np.cumsum(new)])
    total = int(start[-1])
    at = np.repeat(np.arange(m), new)
    depth = np.arange(total) - start[at] + lcp[at] + 1
    first, last = extents(table, at, depth)
    members = np.concatenate([[0], np.cumsum(counts)])
    n_convs = members[last + 1] - members[first]
    conv = least_in(smallest, first, last)
    ends = depth == size[at]
    flat = np.concatenate([np.asarray(c, np.int64) for c in chars]) if total else np.zeros(0, np.int64)
    turn = np.concatenate([[0], np.cumsum(size)])
    length = flat[turn[at] + depth - 1] if total else flat
    # The parent was first had by the leftmost sequence that shares one turn less.
    above, _ = extents(table, at, depth - 1)
    parent = np.where(depth > 1, start[above] + depth - 2 - lcp[above], -1)
    children = np.bincount(parent[parent >= 0], minlength=total)
    border = (first == 0) | (last == m - 1)
    leaf, saved = children == 0, (n_convs - 1) * length
    inside = ~border
    upto = lambda x: np.concatenate([[0], np.cumsum(np.where(inside, x, 0))])  # noqa: E731  what whole nodes before a node add up to
    leaves, spared, below = upto(leaf), upto(saved), start[last + 1]
    n_leaves, s = leaves[below] - leaves[:-1], spared[below] - spared[:-1]
    own_children = np.bincount(parent[(parent >= 0) & inside], minlength=total)
    name = lambda k, d: hashlib.md5(keys[k][: d * NAME].encode(), usedforsecurity=False).hexdigest()
    names: list[str | None] = [None] * total
    for k in np.flatnonzero(border):
        names[k] = name(at[k], depth[k])
    top = hashlib.md5(b"", usedforsecurity=False).hexdigest()
    over = [(top if p < 0 else names[p]) for p in parent.tolist()]
    shas = [hashes[i] if e else None for i, e in zip(at.tolist(), ends.tolist(), strict=True)]
    upper = [None if o is not None else int(conv[p]) for o, p in zip(over, parent.tolist(), strict=True)]
    cols = {
        "kind": ["border" if b else "inner" for b in border], "node": names, "parent": over, "depth": depth, "chars": length, "n_convs": n_convs, "conv_id": conv, "parent_conv_id": upper,
        "n_children": np.where(border, own_children, children), "n_leaves": n_leaves, "saved_tokens": s, "ends_sha256": [h if h or b else NO_ENDS for h, b in zip(shas, border, strict=True)],
    }
    root = {"kind": "border", "node": top, "parent": None, "depth": 0, "chars": 0, "n_convs": int(members[-1]), "conv_id": min(least), "parent_conv_id": None, "n_children": int(((depth == 1) & inside).sum()), "n_leaves": int(leaves[-1]), "saved_tokens": int(spared[-1]), "ends_sha256": hashes[0] if size[0] == 0 else None}
    schema = pa.schema([(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in NODE.split(", ")])
    yield pa.RecordBatch.from_pylist([root], schema)
    for k in range(0, total, 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(cols[f.name][k : k + 50_000], f.type) for f in schema], schema=schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border nodes, each summed over the partitions: what they add to the nodes above, deepest first."""
    rows = {r["node"]: r for b in batches for r in b.to_pylist()}
    for r in rows.values():
        r["leaves"] = r["saved"] = 0  # of border nodes alone: what whole nodes add is in the sums already
    for r in sorted(rows.values(), key=lambda r: -r["depth"]):
        r["leaves"] += r["n_children"] == 0
        r["saved"] += (r["n_convs"] - 1) * r["chars"]
        r["n_leaves"] += r["leaves"]
        r["saved_tokens"] += r["saved"]
        r["ends_sha256"] = r["ends_sha256"] or NO_ENDS
        if above := rows.get(r["parent"]):
            above["n_children"] += 1
            above["leaves"] += r["leaves"]
            above["saved"] += r["saved"]
    schema = pa.schema([("node", pa.string())] + [(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in RESULT.split(", ")])
    out = [{f: r[f] for f in ("node", *COLUMNS) if f != "parent_conv_id"} | {"parent_conv_id": rows[r["parent"]]["conv_id"] if r["parent"] else None} for r in rows.values()]
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(sequences(conversations)))
