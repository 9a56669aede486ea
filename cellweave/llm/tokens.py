"""Token ids of whole texts by a public tokenizer, with a cache of words.

The byte-level BPE splits a text into pieces by a pattern before it merges inside each piece, and a single space
between two other characters always starts a piece. So a text without runs of white space next to a space can be
cut at its spaces, and each part looked up: the same parts come again and again. Everything else goes to the
tokenizer as it is, and so does a text that holds a special token's name, which the tokenizer gives its one id. The
cache belongs to a Python worker, holds a bounded number of parts, and changes no result.
"""

from __future__ import annotations

import array
import os
import sys
from collections.abc import Iterator

#: Parts that a worker keeps; when there are more, it starts anew.
CACHE = 700_000
_PUNCTUATION = frozenset(",.;:!?")
_loaded: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids as little-endian bytes: 2 bytes an id if the vocabulary has at most 65,536 ids, else 4."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.most = cache
        self.clear()

    def clear(self) -> None:
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.warm = False

    def pack(self, ids: list[int]) -> bytes:
        out = array.array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def direct(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, word: str, lead: bool) -> bytes:
        """Ids of one piece, a word or a mark, by the tokenizer's merges alone."""
        own = self.after_space if lead else self.at_start
        ids = own.get(word)
        if ids is None:
            text = (" " + word if lead else word).encode().decode("latin-1").translate(self.letters)
            ids = own[word] = self.pack([t.id for t in self.merge(text)])
        return ids

    def _learn(self, parts: set[str], lead: bool) -> None:
        """Put parts into the cache. Words, marks and line ends are pieces of their own; all else goes through the whole tokenizer."""
        own, piece, rest = self.after_space if lead else self.at_start, self._piece, []
        for p in parts:
            if p.isalpha() and (p.isascii() or max(p) <= "ɏ"):
                piece(p, lead)
            elif not p or p[0].isspace() or p[-1].isspace() or any(s in p for s in self.special):
                self.odd.add(p)
            elif p.isascii() or max(p) <= "ɏ":
                out, first = b"", lead
                for line in p.split("\n"):
                    mark = line[-1:]
                    word = line[:-1] if mark in _PUNCTUATION else line
                    if not word.isalpha():
                        rest.append(p)
                        break
                    out += (b"" if first is lead and not out else piece("\n", False)) + piece(word, first) + (piece(mark, False) if word is not line else b"")
                    first = False
                else:
                    own[p] = out
            else:
                rest.append(p)
        for p, ids in zip(rest, self.direct([" " + p if lead else p for p in rest]), strict=True):
            own[p] = ids

    def _join(self, cut: list[list[str]], which: list[int] | range, out: list[bytes]) -> list[int]:
        """Put the ids of texts into out where all their parts are known, and return the other texts."""
        known, start, rest = self.after_space.__getitem__, self.at_start, []
        for k in which:
            parts = cut[k]
            try:
                out[k] = start[parts[0]] + b"".join(map(known, parts[1:]))
            except KeyError:
                rest.append(k)
        return rest

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.after_space) + len(self.at_start) + len(self.odd) > self.most:
            self.clear()
        cut = [t.split(" ") for t in texts]
        out: list[bytes] = [b""] * len(texts)
        rest: list[int] | range = range(len(texts))
        if self.warm:  # new parts have become rare: most texts need no look for them
            rest = self._join(cut, rest, out)
        first, later = {cut[k][0] for k in rest}, set()
        for k in rest:
            later.update(cut[k][1:])
        first, later = first.difference(self.at_start, self.odd), later.difference(self.after_space, self.odd)
        self.warm = 8 * (len(first) + len(later)) < len(texts)
        self._learn(first, False)
        self._learn(later, True)
        # What is left has parts that only the whole text can tell: runs of white space, or a special token's name.
        rest = self._join(cut, rest, out)
        for k, ids in zip(rest, self.direct([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def release() -> None:
    """Drop the worker's encoders with their caches, for a task of another operator in the same worker."""
    _loaded.clear()


def slices(batches: Iterator, rows: int = 256, chars: int = 4_000_000) -> Iterator[list[dict]]:
    """Rows of Arrow batches in lists of bounded size; a single longer text makes a list of its own."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            out, size = [], 0
            for row in batch.slice(at, rows).to_pylist():
                n = len(row.get("text") or "")
                if out and size + n > chars:
                    yield out
                    out, size = [], 0
                out.append(row)
                size += n
            if out:
                yield out
