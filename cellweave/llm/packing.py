"""Vector bin packing of token sequences by the dot-product heuristic.

Examples have three sizes: tokens, segments and loss-bearing tokens. A sequence has a limit for each. The next example
of a sequence is the one, among those waiting in the task, that fits whole and whose sizes (as shares of the limits)
have the largest dot product with what the sequence has left. When none fits whole, the largest example is cut so
that the sequence becomes full. Texts longer than a sequence are cut into full ones. What a task has left at its end
is cut at powers of two, so that it needs no padding.

Each task packs the rows of its own partition: no shuffle, and at most a window of waiting examples in memory.

Defined results: null text is empty, so only the end id; null and repeated doc_ids are ordinary rows, packed each for
itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_tokenizer, encoder, slices

LENGTH, SEGMENTS, WAITING = 2_048, 512, 1_024

Piece = tuple[int, int, int, int, int]  # example, start, length, sequence, offset


class Packer:
    """Packs examples that arrive one by one; pieces come out as sequences close."""

    def __init__(self, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, waiting: int = WAITING):
        self.limits = np.array([length, segments, loss or length], float)
        self.length, self.waiting, self.sequence = length, waiting, 0
        self.count = 0
        self.slots: list[int] = []  # example in each slot of the window
        self.at = np.zeros((2 * waiting + 1, 3))  # start, end and loss start of what is left of it
        self.sizes = np.zeros((2 * waiting + 1, 3))

    def _set(self, slot: int, start: int, end: int, loss_from: int) -> None:
        self.at[slot] = start, end, loss_from
        self.sizes[slot] = end - start, 1, end - max(start, loss_from)

    def _drop(self, slot: int) -> None:
        last = len(self.slots) - 1
        self.slots[slot] = self.slots[last]
        self.at[slot], self.sizes[slot] = self.at[last], self.sizes[last]
        self.slots.pop()

    def add(self, example: int, tokens: int, loss: int | None = None) -> Iterator[Piece]:
        """One more example of so many tokens, the last `loss` of which bear loss."""
        if tokens <= 0:
            return
        self.slots.append(example)
        self._set(len(self.slots) - 1, 0, tokens, tokens - (tokens if loss is None else loss))
        while len(self.slots) >= self.waiting:
            yield from self._close(self._fill())

    def end(self) -> Iterator[Piece]:
        while self.slots:
            pieces = self._fill()
            yield from self._close(pieces, last=not self.slots)

    def _fill(self) -> list[tuple[int, int, int]]:
        """One sequence's pieces: example, start, length."""
        left, pieces = self.limits.copy(), []
        while self.slots and left[0] > 0 and left[1] >= 1:
            sizes = self.sizes[: len(self.slots)]
            fits = (sizes <= left).all(1)
            if fits.any():
                slot = int(np.where(fits, (sizes / self.limits) @ (left / self.limits), -1).argmax())
                start, end, _ = self.at[slot].astype(int).tolist()
                pieces.append((self.slots[slot], start, end - start))
                left -= self.sizes[slot]
                self._drop(slot)
                continue
            slot = int(sizes[:, 0].argmax())
            start, end, loss_from = self.at[slot].astype(int).tolist()
            take = int(min(left[0], end - start, max(0, loss_from - start) + left[2]))
            if take <= 0:
                break
            pieces.append((self.slots[slot], start, take))
            left -= (take, 1, max(0, start + take - max(start, loss_from)))
            self._set(slot, start + take, end, loss_from)
            if start + take >= end:
                self._drop(slot)
        return pieces

    def _close(self, pieces: list[tuple[int, int, int]], last: bool = False) -> Iterator[Piece]:
        fill = sum(n for _, _, n in pieces)
        parts = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1] if last and fill < self.length else [fill]
        pieces = pieces[::-1]
        for size in parts:
            offset = 0
            while offset < size:
                example, start, n = pieces.pop()
                if n > size - offset:
                    pieces.append((example, start + size - offset, n - size + offset))
                    n = size - offset
                yield example, start, n, self.sequence, offset
                offset += n
            self.sequence += 1


def pack(docs: DataFrame, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, end_id: int = 1, tokenizer: str | None = None, loss_col: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every text: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, if asked for, ids.

    loss_col names the number of a text's last ids that bear loss; without it, all do. sequence_id is the partition's
    number times 2**32 plus the sequence's number in it.
    """
    path = tokenizer or default_tokenizer()
    bears = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = encoder(path)
        end, base = e.pack([end_id]), TaskContext.get().partitionId() << 32
        packer, waiting, count = Packer(length, segments, loss), {}, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"]

        def rows(pieces: list[Piece]) -> pa.RecordBatch:
            out = []
            for example, start, n, sequence, offset in pieces:
                doc_id, ids, loss_from, todo = waiting[example]
                total = len(ids) // e.width
                own = np.frombuffer(ids, f"<u{e.width}", n, start * e.width).astype("<u4")
                out.append((doc_id, start, n, zlib.crc32(own.tobytes()), total, base + sequence, offset, max(0, start + n - max(start, loss_from)), own.tolist() if with_ids else None))
                waiting[example] = (doc_id, ids, loss_from, todo - n)
                if todo == n:
                    del waiting[example]
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:8]] + ([pa.array(cols[8], pa.list_(pa.int64()))] if with_ids else []), names[: 8 + with_ids])

        for part in slices(batches):
            pieces: list[Piece] = []
            for r, ids in zip(part, e.encode([r["text"] or "" for r in part]), strict=True):
                ids += end
                n = len(ids) // e.width
                bearing = n if r["loss"] is None else min(n, max(0, r["loss"]))
                waiting[count] = (r["doc_id"], ids, n - bearing, n)
                pieces += packer.add(count, n, bearing)
                count += 1
            if pieces:
                yield rows(pieces)
        if pieces := list(packer.end()):
            yield rows(pieces)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), bears.alias("loss"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    return own.mapInArrow(run, schema + (", ids array<long>" if with_ids else ""))
