"""Near-duplicate groups with order MinHash and banded alignment.

Each text's three-word runs, labelled with how often they occurred before in it, are hashed once for every
sketch; the two smallest are kept in the order in which they stand in the text. Short texts have sketches of
single words besides, as few of their runs outlive an edit, and the shortest one of all their words. Texts of four
to nine words, of which one may differ, also have a key for each place without the word there, so that none of their
links is left to chance. Texts
with a sketch in common are compared by a word-level edit distance in a band, and linked if it is at most a
fifth of the longer text. Groups are the connected components of the links.

Identical texts are one text from the start. A bucket of texts with one sketch is not paired off: the few of
a small bucket are, a larger one sends each text to its smallest. Then blocks of its texts meet: pairs that
are not in one component yet and that neither their lengths nor what words and runs they share keep apart are
compared, the likeliest first.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_up, hot_from, materialize, pieces, read_table, spread_join, unused
from .words import Words, mix, word_blocks

#: Words of the runs that alignments are tried through. Texts with fewer have one sketch of all their words, as
#: none of them can differ.
GRAM = 5
SIMILARITY = 0.8
#: Words of the runs that are sketched: short ones, so that texts with every fifth word substituted still share many.
RUN = 3
#: Sketches of a text, each of the two smallest hashes.
SKETCHES = 40
#: Texts of up to so many words have so many sketches of single words too.
SHORT, SHORT_SKETCHES = 25, 12
#: Texts of so many words are linked if one edit makes them the same.
ONE_EDIT = range(GRAM - 1, 10)
#: Buckets of up to so many texts are compared pair by pair.
SMALL = 8
#: Texts of a larger bucket meet in blocks of about so many.
BLOCK = 2048
#: Counts of a text's words by hash, so many of a byte each; bits of its runs by hash, at least so many a word.
BINS = 1024
BITS_A_WORD = 4
#: A text of a large bucket is first compared with this many that it has most words in common with; all others
#: follow, but for those that are in one component by then.
LIKELIEST = 8


def _occurrence(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often the same key stood earlier in the same text."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    k, o = key[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    out = np.empty(len(k), np.int64)
    out[order] = np.arange(len(k)) - start
    return out


def order_minhash(words: Words, sketches: int = SKETCHES, run: int = RUN, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts with at least five words (and at most ``longest``), and their sketches (one row a text)."""
    takes_part = (words.count >= GRAM) & (words.count <= longest if longest is not None else True)
    owner = words.owner()
    room = words.room(run) & takes_part[owner]
    gram = words.runs(words.hashes(), run)[room]
    owner = owner[room]
    if not len(owner):
        return np.empty(0, np.int64), np.empty((0, sketches), np.int64)
    gram = mix(gram + _occurrence(owner, gram).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    size = np.diff(np.append(first, len(owner)))
    out = np.empty((len(first), sketches), np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(sketches):
        # One step of a permutation of the hashes is enough: they are mixed already.
        v = (gram ^ np.uint64((j + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xE7037ED1A0B428DB + 2 * j)
        v ^= v >> np.uint64(31)
        least = np.minimum.reduceat(v, first)
        at = np.flatnonzero(v == np.repeat(least, size))  # occurrence labels make it one a text
        at = at[np.searchsorted(at, first)]
        a = gram[at]
        v[at] = top
        second = np.minimum.reduceat(v, first)
        at2 = np.flatnonzero(v == np.repeat(second, size))
        at2 = at2[np.searchsorted(at2, first)]
        b = np.where(size > 1, gram[at2], np.uint64(0))
        low, high = np.where(at < at2, a, b), np.where(at < at2, b, a)
        out[:, j] = mix(low * np.uint64(3) + mix(high + np.uint64(j))).view(np.int64)
    return owner[first], out


def whole_hash(words: Words, texts: np.ndarray) -> np.ndarray:
    """One hash of all words of each of the ``texts`` (numbers), which have fewer than five."""
    one = words.hashes()
    h = words.count[texts].astype(np.uint64)
    for k in range(GRAM - 1):
        some = words.count[texts] > k
        h[some] = mix(h[some] * np.uint64(0xD6E8FEB86659FD93) + one[words.first[texts[some]] + k])
    return h.view(np.int64)


def all_sketches(words: Words, sketches: int = SKETCHES) -> pa.ListArray:
    """The list of each text's sketches, those of single words of the short ones included."""
    who, found = order_minhash(words, sketches)
    short, more = order_minhash(words, SHORT_SKETCHES, 1, SHORT)
    tiny = np.flatnonzero(words.count < GRAM)
    size = np.zeros(len(words.count), np.int64)
    size[who] = sketches
    size[short] += SHORT_SKETCHES
    size[tiny] = 1
    first = np.append(0, np.cumsum(size))
    flat = np.empty(first[-1], np.int64)
    flat[first[who][:, None] + np.arange(sketches)] = found
    flat[first[short][:, None] + sketches + np.arange(SHORT_SKETCHES)] = more
    flat[first[tiny]] = whole_hash(words, tiny)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))


def one_edit_keys(words: Words) -> pa.ListArray:
    """Keys that two texts of ``ONE_EDIT`` words have in common if and, but for chance, only if one edit makes them the same: a
    place and the words without the one there, and those of the texts that lack a word at that place."""
    one, owner, keys = words.hashes(), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]

    def key(columns: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(columns[0]), len(columns), np.uint64)
        for c in columns:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + c)
        return h

    for n in ONE_EDIT:
        texts = np.flatnonzero(words.count == n)
        columns = [one[words.first[texts] + k] for k in range(n)]
        without = [(key(columns[:k] + columns[k + 1 :]), k) for k in range(n)] if n - 1 in ONE_EDIT else []
        whole = [(key(columns), k) for k in range(n + 1)] if n + 1 in ONE_EDIT else []
        for h, k in without + whole:
            owner.append(texts)
            keys.append(mix(h + np.uint64(k + 1)))
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    first = np.append(0, np.cumsum(np.bincount(owner, minlength=len(words.count))))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(keys[np.argsort(owner, kind="stable")].view(np.int64)))


def anchored_bound(a: np.ndarray, b: np.ndarray) -> int:
    """The cost of one alignment, so no less than the edit distance: through the longest ascending chain of runs
    of five words that stand once in each, with what lies between them replaced."""
    if min(len(a), len(b)) < GRAM:
        return max(len(a), len(b))
    grams = []
    for x in (a, b):
        h = np.zeros(len(x) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            h = h * np.uint64(0xD6E8FEB86659FD93) + x[k : len(x) - GRAM + 1 + k].astype(np.uint64)
        key, first, n = np.unique(h, return_index=True, return_counts=True)
        grams.append((key[n == 1], first[n == 1]))
    _, i, j = np.intersect1d(grams[0][0], grams[1][0], assume_unique=True, return_indices=True)
    at_a, at_b = grams[0][1][i], grams[1][1][j]
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    if (np.diff(at_b) <= 0).any():
        keep = _ascending(at_b.tolist())
        at_a, at_b = at_a[keep], at_b[keep]
    if not len(at_a) or not all((a[at_a + k] == b[at_b + k]).all() for k in range(GRAM)):  # two runs with one hash
        return max(len(a), len(b))
    step_a, step_b = np.diff(at_a), np.diff(at_b)
    between = np.maximum(step_a, step_b) - np.minimum(np.minimum(step_a, step_b), GRAM)
    return int(max(at_a[0], at_b[0]) + between.sum() + max(len(a) - at_a[-1], len(b) - at_b[-1]) - GRAM)


def _ascending(values: list[int]) -> list[int]:
    """Places of a longest ascending subsequence."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        j = bisect.bisect_left(tops, v)
        before[k] = top_at[j - 1] if j else -1
        tops[j : j + 1] = [v]
        top_at[j : j + 1] = [k]
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance is within its limit. Most near copies show it by an alignment through
    their common runs; the others are aligned in a band."""
    ok = np.array([anchored_bound(a, b) <= limit for (a, b), limit in zip(pairs, limits.tolist(), strict=True)], bool)
    rest = np.flatnonzero(~ok)
    ok[rest] = edit_distances([pairs[i] for i in rest], limits[rest]) <= limits[rest]
    return ok


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Word edit distance of each pair, or a larger number than its limit once it exceeds that.

    Common ends are cut off, words that only one side has give a lower bound, and what is left is aligned in a
    band that is widened until the distance fits in it; pairs of like length and band advance together.
    """
    out = np.zeros(len(pairs), np.int64)
    todo: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (a, b) in enumerate(pairs):
        n = min(len(a), len(b))
        d = np.flatnonzero(a[:n] != b[:n])
        k = int(d[0]) if len(d) else n
        a, b = a[k:], b[k:]
        n = min(len(a), len(b))
        d = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        k = int(d[0]) if len(d) else n
        a, b = a[: len(a) - k], b[: len(b) - k]
        if not len(a) or not len(b):
            out[i] = len(a) + len(b)
            continue
        top = int(max(a.max(), b.max())) + 1
        extra = np.bincount(a, minlength=top) - np.bincount(b, minlength=top)
        least = max(int(extra[extra > 0].sum()), int(-extra[extra < 0].sum()), abs(len(a) - len(b)))
        if least > limits[i]:
            out[i] = least
        else:
            todo.append((i, a, b))
    band = 8
    while todo:
        todo.sort(key=lambda x: len(x[1]))
        left, k = [], 0
        while k < len(todo):
            group = [todo[k]]
            size = len(todo[k][1]) + len(todo[k][2]) + 4 * band
            most = max(1, min(1 << 12, (1 << 18) // (2 * band + 1), (1 << 23) // size))
            while k + len(group) < len(todo) and len(group) < most and len(todo[k + len(group)][1]) <= 1.2 * len(group[0][1]) + 16:
                group.append(todo[k + len(group)])
            k += len(group)
            found = _banded([g[1] for g in group], [g[2] for g in group], band)
            for (i, a, b), d in zip(group, found.tolist(), strict=True):
                if d <= band or band >= max(len(a), len(b)):
                    out[i] = d
                elif band >= limits[i]:
                    out[i] = limits[i] + 1
                else:
                    left.append((i, a, b))
        todo, band = left, band * 4
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distances within ``band`` diagonals of the main one; exact where they are at most ``band``.

    Cell c of a row r stands for column r + c - band of ``b``; the pairs lie next to one another in memory.
    """
    n, width = len(a), 2 * band + 1
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, columns = int(la.max()), int(lb.max())
    kind, far = (np.int16, 14_000) if rows + columns + 2 * width < 14_000 else (np.int32, 1 << 28)
    x = np.full((rows, n), -1, np.int32)
    y = np.full((max(columns + band, rows + 2 * band) + 1, n), -2, np.int32)
    for i in range(n):
        x[: la[i], i] = a[i]
        y[band : band + lb[i], i] = b[i]
    column = np.arange(width) - band
    row = np.where(column >= 0, column, far).astype(kind)[:, None].repeat(n, 1)
    out = np.full(n, far, np.int64)
    ramp = np.arange(width, dtype=kind)[:, None]
    done_at = np.argsort(la, kind="stable")
    stops = np.searchsorted(la[done_at], np.arange(rows + 2))
    for r in range(1, rows + 1):
        new = row + (y[r - 1 : r - 1 + width] != x[r - 1])
        np.minimum(new[:-1], row[1:] + kind(1), out=new[:-1])
        if r <= band:
            new[: band - r] = far
            new[band - r] = r
        new -= ramp
        np.minimum.accumulate(new, axis=0, out=new)
        new += ramp
        np.minimum(new, far, out=new)
        row = new
        done = done_at[stops[r] : stops[r + 1]]
        if len(done):
            c = lb[done] - r + band
            ok = (c >= 0) & (c < width)
            out[done[ok]] = row[c[ok], done[ok]]
    return out


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, from ``texts`` (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in pieces(batches, 1_500):
            number: dict[str, int] = {}
            coded: dict[str, np.ndarray] = {}

            def code(t: str) -> np.ndarray:
                if t not in coded:
                    coded[t] = np.array([number.setdefault(w, len(number)) for w in t.encode().split()], np.int32)
                return coded[t]

            sides = [(code(s), code(t)) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            limits = np.array([int((1 - similarity) * max(len(s), len(t)) + 1e-9) for s, t in sides])
            ok = within(sides, limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "linked"])

    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, label): each id of ``links`` (a, b) with the smallest id it is connected with.

    Large-star and small-star steps in turn, each written out, until nothing changes.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        last = edges
        # Each end moves on to the least neighbour of its lower one, ...
        low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = materialize(spread_join(edges, low, ["v"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        # ... and all lower neighbours of a node to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, ["u"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(last, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == mark:
            break
        mark = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def known_links(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``links`` with those that give the same components as ``labels`` did."""
    return links if labels is None else links.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b")))


def _text_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"))


def _with_centres(members: DataFrame) -> DataFrame:
    """``members`` (id, n_words, bucket) of buckets of two and more, with the bucket's size ``n`` and smallest id."""
    members = materialize(members)
    sizes = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).where("n > 1"))
    out = materialize(members.join(sizes, "bucket"))  # a hot bucket has one row there, so Spark can split its members
    discard(members, sizes)
    return out


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a the smaller id: all of small buckets, those with the smallest id of larger ones."""
    few = members.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rest = lambda i: F.slice("ids", i + 2, F.greatest(F.size("ids") - i - 1, F.lit(0)))
    every = F.flatten(F.transform("ids", lambda x, i: F.transform(rest(i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = few.select(F.explode(every).alias("p")).select("p.a", "p.b")
    return few.unionByName(_stars(members.where(F.col("n") > SMALL))).distinct()


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the smallest id of each bucket with all others."""
    return members.where(F.col("id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b"))


def word_bags(words: Words) -> np.ndarray:
    """Counts of each text's words by hash, up to 255 (one row a text)."""
    n = len(words.count)
    at = words.owner() * BINS + (words.hashes() >> np.uint64(32)).astype(np.int64) % BINS
    return np.minimum(np.bincount(at, minlength=n * BINS), 255).astype(np.uint8).reshape(n, BINS)


def run_bits(words: Words) -> pa.BinaryArray:
    """Which hashes a text's three-word runs have: a power of two of bits, at least ``BITS_A_WORD`` a word."""
    size = 64 << np.ceil(np.log2(np.maximum(BITS_A_WORD * words.count, 64) / 64)).astype(np.int64)
    first = np.append(0, np.cumsum(size))
    owner, room = words.owner(), words.room(RUN)
    gram, owner = words.runs(words.hashes(), RUN)[room], owner[room]
    bits = np.zeros(first[-1], bool)
    bits[first[owner] + (gram & (size[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((first // 8).astype(np.int32)), pa.py_buffer(np.packbits(bits, bitorder="little"))])


class _Runs:
    """Upper bounds on how many runs texts share, from their ``run_bits``; texts ascend by length."""

    def __init__(self, bits: list[bytes], n_words: np.ndarray):
        self.size = np.array([len(b) // 8 for b in bits])
        self.start = np.searchsorted(self.size, np.unique(self.size))
        self.own: dict[int, tuple[int, np.ndarray]] = {}
        self.half: dict[int, tuple[int, np.ndarray]] = {}
        self.lost, self.half_lost = np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int64)
        runs = np.maximum(n_words - RUN + 1, 0)
        for s, e in zip(self.start.tolist(), [*self.start[1:].tolist(), len(bits)], strict=True):
            x = np.frombuffer(b"".join(bits[s:e]), np.uint64).reshape(e - s, -1)
            self.own[self.size[s]] = (s, x)
            self.lost[s:e] = runs[s:e] - np.bitwise_count(x).sum(1, dtype=np.int64)
            if x.shape[1] > 1:  # the same text with half as many bits
                y = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
                self.half[self.size[s]] = (s, y)
                self.half_lost[s:e] = runs[s:e] - np.bitwise_count(y).sum(1, dtype=np.int64)

    def shared(self, i: int, j: np.ndarray) -> np.ndarray:
        """No fewer than the runs that ``i`` has in common with each of ``j``, which are as long or up to twice."""
        out = np.empty(len(j), np.int64)
        first, own = self.own[self.size[i]]
        mine = own[i - first]
        step = max(1, (1 << 20) // len(mine))
        for size in np.unique(self.size[j]).tolist():
            there = np.flatnonzero(self.size[j] == size)
            first, x = (self.own if size == self.size[i] else self.half)[size]
            lost = (self.lost if size == self.size[i] else self.half_lost)[j[there]]
            for k in range(0, len(there), step):
                some = there[k : k + step]
                out[some] = np.bitwise_count(x[j[some] - first] & mine).sum(1, dtype=np.int64)
            out[there] += np.minimum(lost, self.lost[i])  # runs that fell on one bit
        return out


def possible_pairs(n_words: np.ndarray, label: np.ndarray, block: np.ndarray, earlier: np.ndarray, bags: np.ndarray, bits: list[bytes], similarity: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with different labels and, if there are several blocks, of different ones, that can be linked:
    an edit changes one word and three runs, so enough of both must be common. Pairs that have one of the
    ``earlier`` sketches (a row for each text) in common are left to its bucket. With ``most``, of each row only so
    many, the closest ones."""
    order = np.argsort(n_words, kind="stable")
    n, label, block, earlier, bags = n_words[order], label[order], block[order], earlier[order], bags[order].astype(np.int16)
    runs = _Runs([bits[k] for k in order.tolist()], n)
    limit = ((1 - similarity) * n + 1e-9).astype(np.int64)
    needed = n - RUN + 1 - RUN * limit
    total = bags.sum(1, dtype=np.int64)
    stop = np.searchsorted(n - limit, n, "right")  # no edit distance is below the difference of the lengths
    across = len(n) > 0 and bool((block != block[0]).any())
    left, right = [], []
    for i in range(len(n)):
        some = label[i + 1 : stop[i]] != label[i]
        if across:
            some &= block[i + 1 : stop[i]] != block[i]
        j = i + 1 + np.flatnonzero(some)
        j = j[~(earlier[j] == earlier[i]).any(1)]
        if not len(j):
            continue
        j = j[runs.shared(i, j) >= needed[j]]
        more = np.maximum(bags[j] - bags[i], 0).sum(1, dtype=np.int64)
        least = np.maximum(more, more - total[j] + total[i])
        ok = least <= limit[j]
        j, least = j[ok], least[ok]
        if most is not None and len(j) > most:
            j = j[np.argpartition(least, most)[:most]]
        left.append(np.full(len(j), i))
        right.append(j)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _outlines(texts: DataFrame) -> DataFrame:
    """(id, bag, bits) of ``texts`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches):
            for start, stop, w in word_blocks(b.column(1)):
                bags = pa.array([x.tobytes() for x in word_bags(w)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), bags, run_bits(w)], ["id", "bag", "bits"])

    return texts.select("id", "text").mapInArrow(run, "id long, bag binary, bits binary")


def _meeting(large: DataFrame, labels: DataFrame, outlines: DataFrame, similarity: float, most: int | None) -> DataFrame:
    """Pairs (a, b) of each bucket of ``large`` that can be linked and have different ``labels``, see
    ``possible_pairs``. A bucket's blocks meet each with each, so no task has more than two of them; a pair is met in
    the bucket of its first sketch in common alone (if that one is small, it was compared there)."""
    at = materialize(large.join(labels, "id", "left").select("id", "n_words", "bucket", "n", F.coalesce("label", "id").alias("label")))
    mixed = materialize(at.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("n").alias("size")).where("low != high").select("bucket", "size"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    parted = spread_join(at, mixed, ["bucket"], hot=mixed.where(F.col("size") > hot_from(at.count())))
    met = materialize(parted.join(outlines, "id").select("id", "n_words", "bucket", "label", "sketches", "bag", "bits", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")))
    discard(at, mixed)
    # Buckets of one block share groups: a group has its price.
    groups = max(1, met.count() // (4 * BLOCK))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    met = met.select("id", "n_words", "label", "block", "bucket", "sketches", "bag", "bits", cell.alias("cell"), F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(groups))).otherwise(cell).alias("part"))

    def meet(rows: pa.Table) -> pa.Table:
        give_up()
        ids, n, label, block, bucket, cells = (rows[c].to_numpy() for c in ("id", "n_words", "label", "block", "bucket", "cell"))
        lists = rows["sketches"].combine_chunks()
        size = lists.value_lengths().to_numpy()
        sketches = np.zeros((len(size), size.max()), np.int64)
        sketches[np.arange(size.max()) < size[:, None]] = lists.flatten().to_numpy()
        bag, bits = np.frombuffer(b"".join(rows["bag"].to_pylist()), np.uint8).reshape(-1, BINS), rows["bits"].to_pylist()
        order = np.argsort(cells, kind="stable")
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            place = int((sketches[k[0]] == bucket[k[0]]).argmax())  # a sketch's hash has its place in it
            i, j = possible_pairs(n[k], label[k], block[k], sketches[k, :place], bag[k], [bits[x] for x in k.tolist()], similarity, most)
            a.append(ids[k[i]])
            b.append(ids[k[j]])
        a, b = np.concatenate(a), np.concatenate(b)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return met.groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs`` (doc_id, text), see ``_grouped``. Other columns are ignored."""
    return _grouped(docs, similarity, sketches).select("doc_id", "class_id")


def _grouped(docs: DataFrame, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """(t1, t2, doc_id, class_id, first_id, class_first) for every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest id of the row's group. Two texts are linked if their word edit distance is at
    most ``1 - similarity`` of the longer one's words; words stand between white space (space, tab to
    carriage return). Identical texts are in one group, and so are all without words, empty and null ones
    among them; of two texts under ten words every link is found, so those of one to four words are linked if they are
    the same, and a text of four with one of five that has one word more. A row without an id belongs
    to the group of its text, and to none (null) if no row with that text has an id. Ids must be whole numbers,
    or strings of them. ``first_id`` is the smallest id with the row's very text, and ``class_first`` says
    whether this text is the one of its group that stands for it: of those with the id ``class_id``, the first by hash.
    """
    keyed = _text_keys(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches):
            for start, stop, w in word_blocks(b.column(0)):
                own = b.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), own.column(3), all_sketches(w, sketches), one_edit_keys(w), pa.array(w.count)], ["t1", "t2", "doc_id", "sketches", "keys", "n_words"])

    rows = materialize(keyed.select("t1", "t2", "doc_id"))
    # A text is known by a number of its own from here on.
    found = (keyed.where("doc_id is not null").select("text", "t1", "t2", "doc_id")
             .mapInArrow(sketch, "t1 long, t2 long, doc_id long, sketches array<long>, keys array<long>, n_words long")
             .groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"), F.min("sketches").alias("sketches"), F.min("keys").alias("keys"), F.min("n_words").alias("n_words")))
    sketched = materialize(found.withColumn("id", F.monotonically_increasing_id()))
    members = _with_centres(sketched.select("id", "n_words", F.explode("sketches").alias("bucket")))
    # all texts with a key in common are within one edit of each other, so the smallest stands for them
    near = _with_centres(sketched.select("id", "n_words", F.explode("keys").alias("bucket")))
    pairs = materialize(_pairs(members).unionByName(_stars(near)).distinct())
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = sketched.select("id", "t1", "t2", "first_id").join(involved, "id")
    texts = materialize(keyed.join(ids, ["t1", "t2"]).where("doc_id = first_id").select("id", "text").dropDuplicates(["id"]))
    judged = materialize(_linked(pairs, texts, similarity), 1_500)
    scratch, parts = [members, near, pairs, texts, judged], [judged]
    links, large = judged.where("linked").select("a", "b"), members.where(F.col("n") > SMALL)
    outlines = materialize(_outlines(texts.join(large.select("id").distinct(), "id", "left_semi")).join(sketched.select("id", "sketches"), "id"))
    known = None
    for most in (LIKELIEST, None):
        if large.isEmpty():
            break
        known = materialize(components(known_links(known, links)))
        met = _meeting(large, known, outlines, similarity, most)
        pairs = materialize(met.join(parts[0].select("a", "b"), ["a", "b"], "left_anti"))
        more = materialize(_linked(pairs, texts, similarity), 1_500)
        links = more.where("linked").select("a", "b")
        parts[0] = parts[0].unionByName(more)
        scratch += [known, pairs, more]
    labels = materialize(components(known_links(known, links)))
    own = sketched.select("t1", "t2", "first_id", "id")
    classes = materialize(own.join(labels, "id", "left").select("t1", "t2", "first_id", F.coalesce("label", "id").alias("label")))
    lowest = classes.groupBy("label").agg(F.min(F.struct("first_id", "t1", "t2")).alias("low"))
    classes = materialize(spread_join(classes, lowest, ["label"]).select("t1", "t2", "first_id", F.col("low.first_id").alias("class_id"), ((F.col("low.t1") == F.col("t1")) & (F.col("low.t2") == F.col("t2"))).alias("class_first")))
    discard(sketched, labels, outlines, *scratch)
    return spread_join(rows, classes, ["t1", "t2"], "left")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, with all columns: that of the group's smallest id.

    Of several rows with this id and text any one stays; where this id has different texts of one group, the
    first by hash. Rows in no group, those whose text no row with an id has, stay, all of them.
    """
    c = unused(docs, "id", "t1", "t2")
    found = materialize(_grouped(docs))
    first = found.where("class_first and doc_id = class_id").select(F.col("doc_id").alias(c[0]), F.col("t1").alias(c[1]), F.col("t2").alias(c[2]))
    keep = materialize(first.distinct())
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({c[0]: F.col("doc_id").cast("long"), c[1]: F.xxhash64(text), c[2]: F.xxhash64(F.lit("second"), text)})
    kept = keyed.join(keep, c, "left_semi")
    if first.count() > keep.count():
        kept = kept.dropDuplicates(c)
    nowhere = found.where("class_id is null")
    if not nowhere.isEmpty():
        alone = nowhere.select(F.col("t1").alias(c[1]), F.col("t2").alias(c[2])).distinct()
        kept = kept.unionByName(keyed.where(F.col(c[0]).isNull()).join(alone, c[1:], "left_semi").select(kept.columns))
    return kept.select(*[F.col(f"`{x}`") for x in docs.columns])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, kept) of every document; see ``near_groups`` for nulls, short and repeated texts."""
    found = near_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
