import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import periodic_runs
from lodestone.llm.periodic_runs import Catcher, collapse, repeat_tail, runs_of


def plain_runs(words):
    """Every stretch that agrees with itself at each distance, the smallest distance of equal stretches."""
    found = {}
    n = len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def made(rng, n, letters):
    """Words with runs of several periods, runs in runs, and edits in them."""
    out = []
    while len(out) < n:
        kind = rng.random()
        piece = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 17, 31, 40]))]
        if kind < 0.3:
            piece = [piece[0]] * 9 + piece
        out += piece * (rng.randint(2, 9) if kind < 0.8 else 1) + piece[: rng.randint(0, len(piece))]
        if kind > 0.7 and out:
            out[rng.randrange(len(out))] = rng.choice(letters)
    return out[:n]


def test_equals_every_distance_tried():
    rng = random.Random(5)
    texts = [made(rng, n, letters) for n in (0, 1, 23, 24, 25, 48, 100, 333, 900) for letters in ([b"a"], [b"a", b"b"], [b"a", b"b", b"c", b"d"], [b"%d" % i for i in range(50)]) for _ in range(6)]
    want = [plain_runs(t) for t in texts]
    assert runs_of(texts) == want
    assert sum(map(len, want)) > 200 and {p for r in want for _, _, p in r} >= {1, 3, 5, 7, 8, 9, 13, 16, 17, 31, 40}


def test_word_by_word_equals_all_at_once():
    rng = random.Random(6)
    for letters in ([0], [0, 1], list(range(9))):
        text = np.array(made(rng, 300, letters))
        one, several = Catcher(), Catcher()
        for w in text:
            one.append(np.array([w]))
        for piece in np.array_split(text, 7):
            several.append(piece)
        assert one.runs() == several.runs() == plain_runs(text.tolist())


def test_runs_are_known_before_the_end():
    c = Catcher()
    c.append(np.array([1, 2, 3] * 8))
    assert c.runs() == [(0, 24, 3)]
    c.append(np.array([1, 2]))
    assert c.runs() == [(0, 26, 3)]
    c.append(np.array([9]))
    assert c.runs() == [(0, 26, 3)]


def test_names_that_agree_by_chance(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_mix", lambda a, b: ((a.astype(np.uint64) * np.uint64(31) + b) % np.uint64(5)).astype(np.uint32))
    rng = random.Random(7)
    for _ in range(20):
        text = made(rng, 200, [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"])
        assert set(runs_of([text])[0]) <= set(plain_runs(text))


def test_long_texts():
    rng = random.Random(8)
    assert runs_of([[b"a"] * 200_000])[0] == [(0, 200_000, 1)]
    piece = [b"%d" % rng.randrange(10**9) for _ in range(20_000)]
    assert runs_of([piece * 4 + piece[:7]])[0] == [(0, 80_007, 20_000)]
    assert runs_of([piece, piece, piece]) == [[], [], []]
    nested = ([b"a"] * 100 + [b"b"]) * 1_000
    assert runs_of([nested])[0][:2] == [(0, 100, 1), (0, 101_000, 101)]


def test_collapse_keeps_first_periods():
    words = [b"x", *[b"a", b"b"] * 12, b"y", *[b"c"] * 30]
    assert collapse(words, runs_of([words])[0]) == [b"x", b"a", b"b", b"y", b"c"]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert words == repeat_tail((text or "").encode().split(), doc_id)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    few = [d for d in docs if d.text is None or len(d.text) < 12_000]
    assert len(few) > 150 and any(got[d.doc_id].n_runs for d in few)
    for d in few:
        r = got[d.doc_id]
        assert (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(d.doc_id, d.text)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a " * 30, "x"), (3, " \t\n", "x"), (4, "b c " * 24 + "\x1f", "x"), (5, "a b " * 12, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = sorted(periodic_runs.find_runs(docs).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted([
        ("1", 0, [], ""), ("2", 0, [], ""), ("2", 0, [], ""), ("None", 30, [(0, 30, 1)], "a"), ("3", 0, [], ""), ("4", 25, [(0, 24, 1)], "b c \x1f"), ("5", 24, [(0, 24, 2)], "a b")])
    assert periodic_runs.find_runs(docs, planted=True).count() == 7
    assert periodic_runs.find_runs(docs.where(F.lit(False))).count() == 0
