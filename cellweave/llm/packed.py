"""Entries that travel packed: a compressed row for each task and bucket in place of a row for each entry."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard

Columns = list[np.ndarray]

PACKED = "part int, kind int, data binary"
SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
#: Buckets grow as this power of the text's size in units of so many bytes; the size of one grows as the rest.
UNIT, POWER = 2_000_000, 0.75
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def buckets(size: int | None) -> int:
    """Buckets for so many bytes of text."""
    return max(1, math.ceil(((size or 0) / UNIT) ** POWER))


def pack(columns: Columns, kinds: tuple[str, ...], payload: bytes = b"") -> bytes:
    head = len(columns[0]).to_bytes(4, "little") + b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(head + payload)


def unpack(data: bytes, kinds: tuple[str, ...]) -> tuple[Columns, memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(raw[at : at + size], k))
        at += size
    return out, raw[at:]


def gathered(table: pa.Table, kind: int, kinds: tuple[str, ...]) -> tuple[Columns, list[memoryview]]:
    """All packed entries of a kind in a group."""
    found = [unpack(d.as_py(), kinds) for k, d in zip(table["kind"].to_pylist(), table["data"], strict=True) if k == kind]
    return [np.concatenate([f[0][i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate(kinds)], [f[1] for f in found]


def packed_rows(part: np.ndarray, kind: int, columns: Columns, kinds: tuple[str, ...]) -> pa.RecordBatch:
    """One packed row for each part."""
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    data = [pack([c[order[a:b]] for c in columns], kinds) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ordered[cut[:-1]].astype(np.int32)), pa.array([kind] * len(data), pa.int32()), pa.array(data, pa.binary())], schema=SCHEMA)


def mixed(*values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of columns of numbers."""
    out = np.zeros(len(values[0]), np.uint64)
    for v in values:
        out = (out + v.astype(np.uint64)) * ODD[0]
        out ^= out >> np.uint64(29)
    out *= ODD[2]
    return out ^ (out >> np.uint64(32))
