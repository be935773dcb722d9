import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import nearest


def brute(rows, queries, k=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i, v in queries:
        d = np.sqrt(((x - np.array(v, np.float64)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall(spark):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = nearest.op10_nearest(spark, "/root/testdata/sf0.1").collect()
    true = brute(data, [r for r in data if r[0] % 100 == 0])
    assert {r.query_id for r in got} == set(true) and len(got) == 10 * len(true)
    hits = sum(r.vec_id in {v for v, _ in true[r.query_id]} for r in got)
    assert hits / len(got) >= 0.9
    score = {(r[0], v): d for r in data if r[0] in true for v, d in true[r[0]]}
    assert all(abs(r.score - score[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in score)
    for i in true:
        own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == i)
        assert [o[0] for o in own] == list(range(1, 11)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
            (7, [None, 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (100, [0.0, 1.0], 1), (200, None, 1), (300, [3.0], 1), (9, [5.0], 1), (400, [1.0, 1.0, 1.0], 1), (500, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest.search(df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 2, 0.0), (0, 2, 2, 1.0), (0, 3, 1, 1.414214), (0, 4, 100, 1.414214),
                           (100, 1, 1, 0.0), (100, 2, 2, 1.0), (100, 3, 0, 1.414214), (100, 4, 2, 1.414214), (300, 1, 8, 2.0), (300, 2, 9, 2.0)]
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0
    assert nearest.search(df, F.lit(False)).count() == 0
    twice = spark.createDataFrame([(100, [1.0]), (100, [2.0]), (1, [4.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.search(twice, F.col("vec_id") % 100 == 0).collect())
    assert got == [(100, 1, 100, 1.0), (100, 1, 100, 1.0), (100, 2, 1, 2.0), (100, 2, 1, 3.0)]


def test_recall_at_two_sizes(spark):
    rng = np.random.default_rng(3)
    for n in (2_000, 12_000):
        x = rng.normal(size=(n, 24)) + 2 * rng.normal(size=(20, 24))[rng.integers(0, 20, n)]
        rows = [(i, v) for i, v in enumerate(x.tolist())]
        got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
        true = brute(rows, [r for r in rows if r[0] % 100 == 0])
        assert len(got) == 10 * len(true)
        assert sum(r.vec_id in {v for v, _ in true[r.query_id]} for r in got) / len(got) >= 0.93


def test_one_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i % 7), 1.0, float(i % 11)]) for i in range(1, 900)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    true = brute(rows, [r for r in rows if r[0] % 50 == 0])
    assert len(got) == sum(map(len, true.values()))
    assert all(abs(r.score - true[r.query_id][r["rank"] - 1][1]) < 1e-9 for r in got if r.query_id % 3)
