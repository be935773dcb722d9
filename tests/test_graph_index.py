import tracemalloc

import numpy as np
import pytest

from lodestone.operators import graph_index as gi
from lodestone.operators.search import vector_topk
from lodestone.plans import queries as plans


def made(n, seed, clusters=30, d=24):
    rng = np.random.default_rng(seed)
    return (0.7 * rng.normal(size=(n, d)) + 1.5 * rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)]).astype(np.float32)


def recall(x, links, alive, q, k=10):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = q.astype(np.float64) @ u.T
    true[:, ~alive] = -np.inf
    true = np.argsort(-true, axis=1)[:, :k]
    i, j, compared = gi.search_part(x, links, alive, gi.entry_points(x), q, k)
    assert alive[j].all() and (np.bincount(i, minlength=len(q)) == min(k, alive.sum())).all()
    return np.mean([len(set(j[i == n]) & set(true[n])) / k for n in range(len(q))]), compared / len(q) / len(x)


@pytest.mark.parametrize(("n", "most"), [(2_000, 0.7), (12_000, 0.25)])
def test_recall_at_two_sizes(n, most):
    for clusters in (1, 30, 400):
        x = made(n, 1, clusters)
        q = x[:: n // 150] + 0.1
        links = gi.build_part(x)
        assert (links.max(1) >= 0).all() and ((links >= 0).sum(1) <= gi.MOST).all() and links.max() < n
        found, share = recall(x, links, np.ones(n, bool), q)
        assert found >= 0.95 and share < most


def test_changes_equal_a_rebuild_in_recall():
    x = made(4_000, 2)
    links = gi.build_part(x[:2_500])
    for end in (2_600, 3_300, 4_000):
        links = gi.insert_part(x[:end], links)
    alive = np.arange(4_000) % 5 > 0
    q = x[::29] + 0.1
    changed, _ = recall(x, links, alive, q)
    built, _ = recall(x[alive], gi.build_part(x[alive]), np.ones(alive.sum(), bool), q)
    assert changed >= 0.95 and changed >= built - 0.02


def brute(rows, asked, k):
    out = {}
    for q, v in asked:
        far = sorted((round(1 - float(np.dot(a := np.array(v, np.float64), b := np.array(w, np.float64)) / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), i) for i, w in rows if len(w) == len(v))
        out[q] = [i for _, i in far[:k]]
    return out


def share(found, want):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    assert all([r for r, *_ in sorted(v)] == list(range(1, len(v) + 1)) and [d for _, d, _ in sorted(v)] == sorted(d for _, d, _ in v) for v in got.values())
    assert all(len(got.get(q, [])) == len(w) for q, w in want.items())
    return np.mean([len({i for *_, i in got.get(q, [])} & set(w)) / len(w) for q, w in want.items() if w])


def test_index(spark, tmp_path, monkeypatch):
    x = made(3_000, 3, d=16).tolist()
    frame = lambda rows: spark.createDataFrame(rows, "id long, embedding array<float>")
    index = gi.GraphIndex(spark, str(tmp_path / "graph"))
    rows = list(enumerate(x))
    index.build(frame(rows), part=700)
    assert index.count() == 3_000 and index.store.table(gi.COLLECTION).count() == 5
    asked = [(i, x[i]) for i in range(0, 3_000, 60)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    assert share(index.search(queries, 10), brute(rows, asked, 10)) >= 0.97
    # changes touch only their parts, and older states stay readable
    before, version = index.store._read(gi.COLLECTION)["buckets"], index.store.versions(gi.COLLECTION)[0]
    index.change(frame([(0, x[1])]))
    assert sum(before[b] != v for b, v in index.store._read(gi.COLLECTION)["buckets"].items()) == 1 and index.count() == 3_000
    assert share(index.search(queries, 10, version=version), brute(rows, asked, 10)) >= 0.97
    more = [(i, (np.array(x[i % 3_000]) + 0.05 * (i % 7)).tolist()) for i in range(3_000, 3_400)]
    index.change(frame(more), delete=spark.createDataFrame([(i,) for i in range(1, 3_000, 3)] + [(99_999,)], "id long"))
    rows = [(0, x[1])] + [r for r in rows[1:] if r[0] % 3 != 1] + more
    assert index.count() == len(rows)
    assert share(index.search(queries, 10), brute(rows, asked, 10)) >= 0.97
    monkeypatch.setattr(gi, "QUERIES_AT_ONCE", 20)
    assert share(index.search(queries, 3), brute(rows, asked, 3)) >= 0.97


def test_odd_rows(spark, tmp_path):
    nan = float("nan")
    index = gi.GraphIndex(spark, str(tmp_path / "graph"), "string")
    schema = "key string, v array<double>"
    index.build(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("b", [1.0, 0.1]), ("c", None), (None, [1.0, 0.0]), ("d", [0.0, 0.0]), ("e", [nan, 1.0]), ("f", [1.0]), ("g", [])], schema), "key", "v")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 1.0, 1.0])], "query_id int, embedding array<double>")
    got = lambda: sorted((r.query_id, r["rank"], r.id) for r in index.search(asked, 5).collect())
    assert got() == [(1, 1, "a"), (1, 2, "b"), (2, 1, "f")]
    index.change(spark.createDataFrame([("a", [5.0]), ("h", [0.0, 1.0])], schema), "key", "v", delete=spark.createDataFrame([("b",)], "id string"))
    assert got() == [(1, 1, "h"), (2, 1, "a"), (2, 2, "f")]
    index.build(spark.createDataFrame([], schema), "key", "v")
    assert got() == [] and index.count() == 0


def test_query_finds_what_an_exact_search_finds(spark):
    sf = "/root/testdata/sf0.1"
    got = {(r.query_id, r.id) for r in plans.graph_search(spark, sf).collect()}
    true = {(r.query_id, r.id) for r in vector_topk(plans.vectors(spark, sf), plans.vector_queries(spark, sf), 10).collect()}
    assert len(got) == len(true) and len(got & true) / len(true) >= 0.95


@pytest.mark.parametrize("copies", [0, 4_000])
def test_a_part_takes_little_memory(copies):
    """However many vectors have links to the same one."""
    x = made(8_000, 6, d=32)
    x[:copies] = x[0]
    tracemalloc.start()
    try:
        links = gi.insert_part(x, gi.build_part(x[:6_000]))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 80 and links.shape == (8_000, gi.MOST) and (links.max(1) >= 0).all()
    assert all(len(set(own)) == len(own) and i not in own for i, row in enumerate(links[::50]) if (own := row[row >= 0].tolist()) for i in [50 * i])
    found, _ = recall(x, links, np.ones(8_000, bool), x[copies::100] + 0.1)
    assert found >= 0.95
