"""Hashes of words and of runs of words, computed on Arrow buffers without a Python object per word."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The bytes between words: space, and tab to carriage return. They never occur inside a UTF-8 character.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of text handled at once, but for single texts that are longer.
BLOCK = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of some texts: ``start`` and ``end`` in ``data``, and ``first``, the number of the first word of
    each text (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        after = np.zeros(len(data) + 1, bool)
        after[1:] = inside
        border = offsets[:-1][np.diff(offsets) > 0]
        opens = inside & ~after[:-1]
        opens[border] = inside[border]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[border[border > 0] - 1] = inside[border[border > 0] - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``which`` picks one of two independent ones."""
        base = np.uint64(_BASES[which])
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(self.data)
        power = np.cumprod(np.full(n + 1, base, np.uint64)) if n else np.ones(1, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        back = np.cumprod(np.full(n + 1, inverse, np.uint64))
        return mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))

    def runs(self, word_hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; meaningless where a text has fewer left."""
        n = len(word_hashes)
        h = np.zeros(n, np.uint64)
        if n >= k:
            for j in range(k):
                h[: n - k + 1] = h[: n - k + 1] * np.uint64(0xD6E8FEB86659FD93) + word_hashes[j : n - k + 1 + j]
        return mix(h)

    def room(self, k: int) -> np.ndarray:
        """Whether ``k`` words of the same text stand from each word on."""
        left = np.repeat(self.first[1:], self.count) - np.arange(len(self.start))
        return left >= k

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def text(self, i: int, keep: np.ndarray) -> bytes:
        """The words of text ``i`` that ``keep`` has, joined by one space."""
        words = self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()  # at the same bytes
        return b" ".join(words if keep.all() else itertools.compress(words, keep.tolist()))


def word_blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) over rows of a string column; a null text has no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + block, "right")) - 1)
        b = min(b, n)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b
