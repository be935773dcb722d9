import random
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import near_dedup as nd
from lodestone.llm.words import Words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, new = i, [i]
        for j, y in enumerate(b, 1):
            left = min(left + 1, row[j] + 1, row[j - 1] + (x != y))
            new.append(left)
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randrange(60))]
        b = list(a)
        for _ in range(rng.randrange(14)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = [rng.randrange(30) for _ in range(rng.randrange(3))]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    pairs.append((np.arange(500, dtype=np.int32), np.append(np.arange(40, 500), np.arange(40)).astype(np.int32)))
    for share in (0.2, 1.0):
        limits = np.array([int(share * max(len(a), len(b))) for a, b in pairs])
        got = nd.edit_distances(pairs, limits)
        for (a, b), d, limit in zip(pairs, got.tolist(), limits.tolist(), strict=True):
            true = distance(a.tolist(), b.tolist())
            assert d == true if true <= limit else d > limit
            assert nd.anchored_bound(a, b) >= true
        assert nd.within(pairs, limits).tolist() == (got <= limits).tolist()


def test_documents(spark):
    docs = [(r.doc_id, r.text.encode().split()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in nd.op7_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    runs, near = defaultdict(set), defaultdict(int)
    for k, (_, w) in enumerate(docs):
        for i in range(len(w) - 4):
            runs[tuple(w[i : i + 5])].add(k)
    for some in runs.values():
        for a in some:
            for b in some:
                if a < b:
                    near[a, b] += 1
    links = []
    for (a, b), n in near.items():
        x, y = docs[a][1], docs[b][1]
        limit = int(0.2 * max(len(x), len(y)) + 1e-9)
        number: dict = {}
        code = lambda w: np.array([number.setdefault(v, len(number)) for v in w], np.int32)
        if n >= 2 and abs(len(x) - len(y)) <= limit and nd.edit_distances([(code(x), code(y))], np.array([limit]))[0] <= limit:
            links.append((docs[a][0], docs[b][0]))
    parent = {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    true = {i: find(i) for i, _ in docs}
    by_text = {}
    for i, w in docs:
        true[i] = min(true[i], true[by_text.setdefault(tuple(w), i)]) if len(w) < 5 else true[i]
    lost = [(a, b) for a, b in links if got[a] != got[b]]
    assert len(links) > 50 and len(lost) <= 0.02 * len(links)
    wrong = [i for i in got if len(docs) and true[got[i]] != true[i]]
    assert not wrong


def test_large_group_and_odd_rows(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(80)] = f"x{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(1, "clean text of its own with several words in it"), (2, None), (3, ""), (4, "a b"), (5, "a b"), (None, "a b"), (None, "no id has this text"), (6, "a b c"), (7, " ".join(f"k{i}" for i in range(9000))),
             (8, " ".join(f"k{i}" for i in range(40, 9000))), (1, "clean text of its own with several words in it"), (9, " ".join(base[:40] + [f"z{i}" for i in range(40)]))]
    df = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, text string, class_id int, t1 string")
    got = nd.near_groups(df).collect()
    assert len(got) == len(rows)
    classes = defaultdict(set)
    for r in got:
        classes[r.doc_id].add(r.class_id)
    assert {c for i in range(60) for c in classes[1000 + i]} == {1000}
    assert classes[1] == {1} and classes[2] == classes[3] == {2} and classes[4] == classes[5] == {4} and classes[6] == {6} and classes[7] == classes[8] == {7} and classes[9] == {9}
    assert classes[None] == {4, None}
    kept = nd.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 4, 6, 7, 9, 1000)] + [(True, 0)]
    assert nd.near_groups(df.limit(0)).count() == 0


def test_copies_of_one_original_that_are_not_copies_of_one_another(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(50, base)]
    for i in range(1, 31):
        w = list(base)
        for k in rng.sample(range(60, 150), 25):
            w[k] = f"x{i}_{k}"
        rows.append((i, w))
    assert all(distance(w, base) <= 30 for _, w in rows)
    assert sum(distance(w, rows[1][1]) > 30 for _, w in rows[2:]) > 25
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.class_id for r in nd.near_groups(df).collect()} == {1}


def test_possible_pairs_lose_no_link():
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        base = [str(rng.randrange(rng.choice((2, 40, 5_000)))) for _ in range(rng.choice((rng.randrange(10, 50), rng.randrange(100, 300))))]
        texts += [base, [w if rng.random() > 0.15 else "z" for w in base], base[rng.randrange(9) :]]
    words = Words(np.frombuffer(b"".join(" ".join(t).encode() for t in texts), np.uint8), np.cumsum([0] + [len(" ".join(t)) for t in texts]))
    n, label, bags = words.count, np.arange(len(texts)) // 2, nd.word_bags(words)
    near = {(i, j) for i in range(len(texts)) for j in range(i) if distance(texts[i], texts[j]) <= int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)}
    for block in (np.zeros(len(n), int), np.arange(len(n)) % 2):
        found = {(max(p), min(p)) for p in zip(*(x.tolist() for x in nd.possible_pairs(n, label, block, np.empty((len(n), 0), np.int64), bags, nd.run_bits(words).to_pylist(), 0.8, None)), strict=True)}
        true = {(i, j) for i, j in near if label[i] != label[j] and (not block.any() or block[i] != block[j])}
        assert len(true) > 10 and true <= found and len(found) < len(n) * (len(n) - 1) / 4
        met = (np.arange(len(n)) // 3)[:, None]  # those of one third have a sketch in common already
        later = {(max(p), min(p)) for p in zip(*(x.tolist() for x in nd.possible_pairs(n, label, block, met, bags, nd.run_bits(words).to_pylist(), 0.8, None)), strict=True)}
        assert later == {(i, j) for i, j in found if i // 3 != j // 3}


def test_few_pairs_at_the_threshold_are_lost(spark):
    rng = random.Random(11)
    sizes = [5, 6, 10, 15, 25, 26, 30, 60, 120, 300] * 40
    rows = []
    for i, n in enumerate(sizes):
        w = [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
        rows.append((2 * i, " ".join(w)))
        for k in rng.sample(range(n), n // 5):
            w[k] = f"y{rng.randrange(1 << 40)}"
        rows.append((2 * i + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_groups(df).collect()}
    assert all(got[i] // 2 == i // 2 for i in got)
    lost = [n for i, n in enumerate(sizes) if got[2 * i + 1] != 2 * i]
    print("lost", Counter(lost), "of", Counter(sizes))
    assert len(lost) <= 0.02 * len(sizes) and max(Counter(lost).values(), default=0) <= 4


def test_links_of_texts_with_one_passage_in_common(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(78)]
    rows = []
    for i in range(300):
        rows.append(passage + [f"u{rng.randrange(1 << 40)}" for _ in range(rng.randrange(80, 130))])
    for i in range(60):
        w = list(rows[5 * i])
        for k in rng.sample(range(len(w)), int(0.19 * len(w))):
            w[k] = f"e{rng.randrange(1 << 40)}"
        rows.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_groups(df).collect()}
    lost = [i for i in range(60) if got[300 + i] != 5 * i]
    assert len(lost) <= 3  # those whose sketches all differ: the sketches' own loss at this distance
    assert all(c == i or i >= 300 and c == 5 * (i - 300) for i, c in got.items())


def test_short_texts_with_other_spaces(spark):
    rows = [(1, "a b c d"), (2, "a  b c d"), (3, "a b c"), (4, " a b\tc\n"), (5, ""), (6, " \n"), (7, None), (8, "a b d c"), (9, "ab c"), (10, "x"), (11, "x ")]
    got = {r.doc_id: r.class_id for r in nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10, 11: 10}


def test_hot_keys_are_joined_apart(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, base) for i in range(3_000)] + [(3_000 + i, f"{base} e{i}") for i in range(1_200)] + [(5_000 + i, f"text of its own number n{i} with m{i} k{i}") for i in range(50)]
    got = {r.doc_id: r.class_id for r in nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(c == (0 if i < 5_000 else i) for i, c in got.items())


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (1, b), (1, a), (2, a + " z"), (3, b), (4, "own text")]
    kept = nd.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b), (4, "own text")])


def all_pairs_groups(texts):
    """Class of each text (the smallest id), every pair compared; texts are (id, words)."""
    parent = {i: i for i, _ in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(texts):
        for j, y in texts[:k]:
            limit = int(0.2 * max(len(x), len(y)) + 1e-9)
            if abs(len(x) - len(y)) <= limit and find(i) != find(j):
                number: dict = {}
                a, b = (np.array([number.setdefault(v, len(number)) for v in w], np.int32) for w in (x, y))
                if nd.edit_distances([(a, b)], np.array([limit]))[0] <= limit:
                    i_, j_ = find(i), find(j)
                    parent[max(i_, j_)] = min(i_, j_)
    return {i: find(i) for i, _ in texts}


def test_all_pairs_of_documents(spark):
    docs = sorted((r.doc_id, (r.text or "").encode().split()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    true = all_pairs_groups(docs)
    assert len(set(true.values())) < len(docs)
    assert {r.doc_id: r.class_id for r in nd.op7_near_dedup(spark, "/root/testdata/sf0.001").collect()} == true


def test_no_link_of_short_texts_is_lost(spark):
    rng = random.Random(12)
    rows = [(0, "a b c d"), (1, "a b c d e"), (2, "a x b c d"), (3, "q a b c d"), (4, "a b c"), (5, "a b c d a")]
    for k in range(500):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))]
        rows.append((len(rows), " ".join(words)))
        if k % 2:
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choices("abcdefgh", k=rng.randint(0, 1))
            rows.append((len(rows), "  ".join(words[:9])))
    texts = [(i, t.encode().split()) for i, t in rows]
    got = {r.doc_id: r.class_id for r in nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    true = all_pairs_groups(texts)
    assert got == true and got[1] == got[0] == got[2] == got[3] and len(set(true.values())) > 100
