"""Byte-pair encoding as a search over prefixes, many words at a time.

A segmentation is the encoder's own result exactly when each pair of neighbouring pieces could not have
merged across their border. So a prefix has one last piece that fits the best segmentation of what stands
before it, and words of equal length can advance together, one symbol at a time: hashes of all substrings
that end there probe the sorted keys of the pieces, the border test removes what does not fit, and the
largest fitting length is stored as the backpointer.
"""

from __future__ import annotations

import heapq

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 20)
_NEVER = np.int64(1 << 40)


def agenda_encode(symbols: list[int], merged: dict[tuple[int, int], tuple[float, int]]) -> list[int]:
    """Merge neighbours by (rank, position) until none is left. ``merged``: (left, right) -> (rank, piece)."""
    piece, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    alive, heap = [True] * len(piece), []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(piece) and (m := merged.get((piece[i], piece[j]))):
            heapq.heappush(heap, (m[0], i, piece[i], j, piece[j], m[1]))

    for i in range(len(piece) - 1):
        offer(i)
    while heap:
        _, i, left, j, right, new = heapq.heappop(heap)
        if not (alive[i] and alive[j] and piece[i] == left and piece[j] == right and after[i] == j):
            continue
        piece[i], alive[j], after[i] = new, False, after[j]
        if after[i] < len(piece):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p, a in zip(piece, alive, strict=True) if a]


class KeyTable:
    """Sorted 64-bit keys, probed through their leading bits: ``first[b] .. first[b + 1]`` have the bits b."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.sorted, self.values = keys[order], values[order]
        self.first = np.searchsorted(self.sorted >> _SHIFT, np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``key`` are there, and their values."""
        bits = (key >> _SHIFT).astype(np.int64)
        at = self.first[bits]
        some = np.flatnonzero(at < self.first[bits + 1])
        at, key, stop = at[some].astype(np.int64), key[some], self.first[bits[some] + 1]
        found = np.full(len(some), -1, np.int64)
        for _ in range(self.most):
            same = self.sorted[np.minimum(at, len(self.sorted) - 1)] == key
            found = np.where(same & (at < stop), at, found)
            at += 1
        hit = found >= 0
        return some[hit], self.values[found[hit]]


class Lattice:
    """``pieces``: symbol tuples; ``merges``: (left, right, new) piece numbers in order of rank, one for each
    merged piece. A piece of one symbol is a base piece. The piece number ``len(pieces)`` stands for a symbol
    that no piece has."""

    def __init__(self, pieces: list[tuple[int, ...]], merges: list[tuple[int, int, int]]):
        n = self.unknown = len(pieces)
        self.rank = np.full(n + 1, -1, np.int64)
        self.left = np.arange(n + 1, dtype=np.int64)
        self.right = self.left.copy()
        for rank, (a, b, new) in enumerate(merges):
            self.rank[new], self.left[new], self.right[new] = rank, a, b
        keep = [i for i, p in enumerate(pieces) if len(p) == 1 or self.rank[i] >= 0]
        self.longest = max(len(pieces[i]) for i in keep)
        self.lengths = np.array(sorted({len(pieces[i]) for i in keep}))
        self.index = {pieces[i]: i for i in keep}
        self.powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.longest):
                self.powers[i + 1] = self.powers[i] * _BASE
            keys = _mixed(np.array([self._hash(pieces[i]) for i in keep], np.uint64))
        assert len(np.unique(keys)) == len(keys), "two pieces share a key"
        self.keys = KeyTable(keys, np.array(keep, np.int64))
        self.symbols = np.full((n + 1, self.longest), -1, np.int32)
        for i in keep:
            self.symbols[i, : len(pieces[i])] = pieces[i]
        pair = np.array([a * (n + 1) + b for a, b, _ in merges], np.uint64)
        self.pairs = KeyTable(_mixed(pair), np.arange(len(merges), dtype=np.int64))
        self.fits_cache: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _hash(symbols) -> np.uint64:
        h = np.uint64(0)
        for s in symbols:
            h = h * _BASE + np.uint64(s + 1)
        return h

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), _NEVER)
        hit, rank = self.pairs.probe(_mixed((a * np.int64(self.unknown + 1) + b).astype(np.uint64)))
        out[hit] = rank
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces ``a`` and ``b`` can stand side by side: no merge across their border ever came first.

        Goes back in time: the piece at the border that was made last is taken apart, and the two pieces that
        face each other must not merge before either goes into a larger one. Equal ranks merge from the left.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until_a = np.full(len(a), _NEVER)
        until_b = until_a.copy()
        while len(live):
            rank = self._merge_rank(a, b)
            bad = (rank < until_a) & (rank <= until_b) & (rank < _NEVER)
            ok[live[bad]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            on = ~bad & ((rank_a >= 0) | (rank_b >= 0))
            live, a, b, until_a, until_b, rank_a, rank_b = (x[on] for x in (live, a, b, until_a, until_b, rank_a, rank_b))
            left = rank_a > rank_b
            until_a = np.where(left, rank_a, until_a)
            until_b = np.where(left, until_b, rank_b)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return ok

    def last_pieces(self, words: np.ndarray) -> np.ndarray:
        """Last piece of every prefix, for a matrix of words of one length (symbols, one word a row)."""
        n, length = words.shape
        last = np.full((n, length), self.unknown, np.int64)
        size = np.ones((n, length), np.int64)
        h = np.zeros((n, length + 1), np.uint64)
        for j in range(length):
            h[:, j + 1] = h[:, j] * _BASE + (words[:, j] + 1).astype(np.uint64)
        rows = np.arange(n)
        for end in range(1, length + 1):
            lengths = self.lengths[self.lengths <= end]
            key = h[:, end : end + 1] - h[:, end - lengths] * self.powers[lengths]
            hit, piece = self.keys.probe(_mixed(key.ravel()))
            row, l = hit // len(lengths), lengths[hit % len(lengths)]
            inner = l < end
            good = ~inner
            good[inner] = self.fits(last[row[inner], end - l[inner] - 1], piece[inner])
            row, l, piece = row[good], l[good], piece[good]
            best = np.zeros(n, np.int64)
            np.maximum.at(best, row, l)
            winner = best[row] == l
            same = (self.symbols[piece[winner]][:, : int(l.max(initial=0))] == _window(words, row[winner], end, l[winner])).all(1)
            assert same.all(), "a substring has the key of another piece"
            last[row[winner], end - 1] = piece[winner]
            size[rows, end - 1] = np.maximum(best, 1)
        self._size = size
        return last

    def _fits_one(self, a: int, b: int) -> bool:
        found = self.fits_cache.get((a, b))
        if found is None:
            if len(self.fits_cache) > 200_000:
                self.fits_cache.clear()
            found = self.fits_cache[a, b] = bool(self.fits(np.array([a]), np.array([b]))[0])
        return found

    def last_pieces_long(self, word) -> tuple[list[int], list[int]]:
        """The same for one long word: last piece and its length at every prefix, in linear time."""
        last, size, lengths = [], [], self.lengths.tolist()
        for end in range(1, len(word) + 1):
            piece, best = self.unknown, 1
            for l in lengths:
                if l > end:
                    break
                t = self.index.get(tuple(word[end - l : end]))
                if t is not None and (l == end or self._fits_one(last[end - l - 1], t)):
                    piece, best = t, l
            last.append(piece)
            size.append(best)
        return last, size

    def solve(self, words: list, longest: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each word (a sequence of symbols) the last piece of every prefix and that piece's length."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > longest:
                last, size = self.last_pieces_long(w)
                out[i] = (np.array(last, np.int64), np.array(size, np.int64))
            elif len(w) == 0:
                out[i] = (np.empty(0, np.int64), np.empty(0, np.int64))
            else:
                by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            for k in range(0, len(rows), 8192):
                some = rows[k : k + 8192]
                mat = np.array([list(words[i]) for i in some], np.int64).reshape(len(some), length)
                last = self.last_pieces(mat)
                for r, i in enumerate(some):
                    out[i] = (last[r], self._size[r])
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """One to one, so that leading bits differ as much as the others."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window(words: np.ndarray, row: np.ndarray, end: int, l: np.ndarray) -> np.ndarray:
    """The last ``l`` symbols before ``end``, left-aligned, -1 beyond."""
    width = int(l.max(initial=0))
    at = end - l[:, None] + np.arange(width)
    return np.where(np.arange(width) < l[:, None], words[row[:, None], np.minimum(at, words.shape[1] - 1)], -1)


def backtrack(last: np.ndarray, size: np.ndarray) -> list[int]:
    """The pieces of a whole word from its backpointers."""
    out, end = [], len(last)
    while end:
        out.append(int(last[end - 1]))
        end -= int(size[end - 1])
    return out[::-1]


def prefix_counts(size: np.ndarray) -> np.ndarray:
    """Number of pieces of every prefix."""
    count = np.zeros(len(size) + 1, np.int64)
    for end in range(1, len(size) + 1):
        count[end] = count[end - size[end - 1]] + 1
    return count[1:]


def counts_matrix(size: np.ndarray) -> np.ndarray:
    """``prefix_counts`` for words of one length at once."""
    n, length = size.shape
    count = np.zeros((n, length + 1), np.int64)
    rows = np.arange(n)
    for end in range(1, length + 1):
        count[:, end] = count[rows, end - size[:, end - 1]] + 1
    return count[:, 1:]
