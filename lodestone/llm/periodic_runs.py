"""Periodic runs of words by online dyadic square catching.

The words of a text are appended to a catcher. It names, for every power of two ``B``, the ``B`` words that end
at each place, from two names of the level below. Each completed block of ``B`` words at a multiple of ``B`` is
watched at the distances from ``B`` to ``2B - 1``: a word appended completes one more suffix of ``B`` words, which
is compared with the one block that lies at such a distance. A run of three periods ``p`` repeats every aligned
block of its first two periods at the distance ``p``, and one of the largest power of two up to ``p`` always fits in
there, so no run is missed. A block that comes again is a square caught: how far both places agree to the
left and to the right is read from the names, level by level, and squares of one run merge.

Names are 32-bit hashes, so equal words have equal names. What they find is compared word by word, by numbers
that only equal words share; a stretch that turns out wrong is measured again on the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_up, pieces, read_table

#: A run has at least so many words, and so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Blocks of the lowest level. They serve all periods under twice that: 16 words of a run of 24 come again.
BASE = 8
#: Words of several texts that are appended together; a longer text stands alone.
BLOCK = 1 << 18


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


class Catcher:
    """Finds runs of numbers that are appended, a few or many at a time.

    ``word`` holds the numbers so far and ``names[k]`` the name of the ``2 ** k`` ones from each place on.
    ``squares`` has the end of each stretch known by its start and period; those that reach the end of what was
    appended may still grow.
    """

    def __init__(self) -> None:
        self.word = np.zeros(0, np.int64)
        self.names: list[np.ndarray] = []
        self.squares: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        """Take in the next words and catch the squares they complete."""
        before = len(self.word)
        self.word = np.concatenate((self.word, words))
        n, level = len(self.word), 0
        while 1 << level <= n:
            self._name(level)
            size = 1 << level
            if size >= BASE:
                suffix = np.arange(max(0, before - size + 1), n - size + 1)
                self._catch(level, suffix // size * size - size, suffix)  # at distances from size to 2 * size - 1
                if size == BASE:
                    self._catch(level, (suffix - 1) // size * size, suffix)  # and from 1 to size
            level += 1

    def _name(self, level: int) -> None:
        if level == len(self.names):
            self.names.append(np.zeros(0, np.uint32))
        have, n = len(self.names[level]), len(self.word) - (1 << level) + 1
        if level == 0:
            fresh = self.word[have:n]
            fresh = _mix(fresh.astype(np.uint64) & np.uint64(0xFFFFFFFF), fresh.astype(np.uint64) >> np.uint64(32))
        else:
            below, half = self.names[level - 1], 1 << (level - 1)
            fresh = _mix(below[have:n], below[have + half : n + half].astype(np.uint64))
        self.names[level] = np.concatenate((self.names[level], fresh)) if have else fresh

    def _catch(self, level: int, block: np.ndarray, suffix: np.ndarray) -> None:
        """Squares of which ``block`` and the equal ``suffix`` are places; each stretch is measured once."""
        name = self.names[level]
        block, suffix = block[block >= 0], suffix[block >= 0]
        hit = name[block] == name[suffix]
        block, period = block[hit], (suffix - block)[hit]
        if not len(block):
            return
        # blocks of one stretch follow each other: of neighbours at one distance the first speaks for all
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        size = 1 << level
        first = np.r_[True, (period[1:] != period[:-1]) | (block[1:] != block[:-1] + size)]
        block, period = block[first], period[first]
        end = block + self._agree(block, block + period, 1) + period
        start = block - self._agree(block, block + period, -1)
        worth = (end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)) | (end == len(self.word))
        found = np.unique(np.stack((start[worth], period[worth], end[worth])), axis=1)
        for s, p, e in found.T.tolist():
            self.squares[s, p] = max(e, self.squares.get((s, p), 0))

    def _agree(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many numbers from places ``a`` and ``b`` > ``a`` on are the same, to the right or before them to the left."""
        out = np.zeros(len(a), np.int64)
        steps = [*range(len(self.names))]
        for level in [*steps, *steps[::-1]]:  # up while it goes, then down for the rest
            size, name = 1 << level, self.names[level]
            left, right = (a + out, b + out) if way > 0 else (a - out - size, b - out - size)
            fits = (left >= 0) & (right < len(name))
            fits[fits] = name[left[fits]] == name[right[fits]]
            out += np.where(fits, size, 0)
        return out

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of what was appended so far, by start and then period."""
        if not self.squares:
            return []
        found = np.array([(s, p, e) for (s, p), e in self.squares.items()])
        start, period, end = found[found[:, 1].argsort(kind="stable")].T
        end = end + self._agree(end - period, end, 1)
        least: dict[tuple[int, int], int] = {}
        for s, p, e in zip(start.tolist(), period.tolist(), end.tolist(), strict=True):
            if (s, e) not in least:  # multiples of a period have its stretch
                for a, z in self._exactly(s, p, e):
                    if z - a >= max(LEAST_WORDS, LEAST_PERIODS * p):
                        least.setdefault((a, z), p)
        return sorted((s, e - s, p) for (s, e), p in least.items())

    def _exactly(self, start: int, period: int, end: int) -> Iterator[tuple[int, int]]:
        """The stretch, or its parts if two names in it were the same by chance, by the words themselves."""
        differ = np.flatnonzero(self.word[start : end - period] != self.word[start + period : end])
        cuts = [-1, *differ.tolist(), end - period - start]
        for before, after in zip(cuts, cuts[1:], strict=False):
            yield start + before + 1, start + after + period


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers, equal for equal words only; a number of its own after each text."""
    known: dict[bytes, int] = {}
    out = []
    for i, words in enumerate(texts):
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        out.append(np.array([-1 - i], np.int64))
    return np.concatenate(out)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text: (start, length, period) by start and then period.

    Texts go through one catcher with a number between them that stands nowhere else, so no run passes from one to
    the next.
    """
    catcher = Catcher()
    catcher.append(_numbers(texts))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, length, p in catcher.runs():
        i = int(np.searchsorted(starts, s, "right")) - 1
        out[i].append((s - int(starts[i]), length, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        depth[s + p] += 1
        depth[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, for a tenth of the ids with a tail that repeats one piece of them; a null id leaves them as they are."""
    n = len(words)
    if doc_id is None or not n or (h := crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * -(-(n - a) // p))[: n - a]


def find_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(doc_id, n_words, n_runs, runs, collapsed) for every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than space and tab to carriage return. A run is a stretch of words with smallest
    period ``p``, at least 24 words and three periods long, that no neighbouring word extends; ``runs`` has them as
    (start, length, period) by start, then period. ``collapsed`` is the words that no run contains after its first
    period, joined by one space. A null or empty text has no words and no runs. Rows with one id are judged each on
    its own; ids may be null. An empty table gives no rows; other columns are ignored. Memory grows with the longest text.
    ``planted`` repeats a piece at the end of a tenth of the texts first, see ``repeat_tail``.
    """

    def judge(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts)
        kept = [b" ".join(collapse(t, r)).decode() for t, r in zip(texts, found, strict=True)]
        runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
        counts = [pa.array([len(x) for x in own], pa.int64()) for own in (texts, found)]
        return pa.RecordBatch.from_arrays([ids, *counts, pa.array(runs, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_runs", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches, 100):
            texts, size, ids = [], 0, b.column(0)
            for i, text in enumerate(b.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if planted:
                    words = repeat_tail(words, ids[i].as_py())
                if texts and size + len(words) > BLOCK:
                    yield judge(ids.slice(i - len(texts), len(texts)), texts)
                    texts, size = [], 0
                texts.append(words)
                size += len(words)
            if texts:
                yield judge(ids.slice(b.num_rows - len(texts)), texts)

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _strongest(runs: list[dict]) -> dict | None:
    """Of the greatest exact length a period; of equal ones the first, then the one of the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every document, of
    which a tenth get a repeated tail first; see ``find_runs`` and ``repeat_tail``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(1).to_pylist()
            best = [_strongest(r) or {} for r in runs]
            lines = [hashlib.sha256("".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r).encode()).hexdigest() for r in runs]
            numbers = [pa.array([x.get(k) for x in best], pa.int64()) for k in ("start", "length", "period")]
            milli = pa.array([1000 * x["length"] // x["period"] if x else None for x in best], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *numbers, milli, pa.array(lines, pa.string()), b.column(3)],
                                             ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    found = find_runs(read_table(spark, sf_dir, "documents"), planted=True)
    digests = found.select("doc_id", "runs", "n_runs", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    kind = found.schema["doc_id"].dataType.simpleString()
    return digests.mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
