from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives
from lodestone.llm.hard_negatives import descend, mine, spanning_trees

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """Every pair scored; rows are (vec_id, label, vector), each one of its own."""
    rows = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows]
    out = []
    for a, (i, label, v) in enumerate(rows):
        if not anchor(i):
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for b, (j, other, w) in enumerate(rows) if b != a and len(w) == len(v)]
        for s, j, _ in sorted(x for x in score if x[2] == label)[:positives]:
            fits = sorted(x for x in score if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, j, k + 1, o, -s, -t) for k, (t, o, _) in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def clustered(n, seed, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    label = rng.integers(0, 6, n)
    x = (centres[label] + 0.2 * rng.normal(size=(n, d))).astype(np.float32)
    return [(i, int(label[i]) % 4, x[i].tolist()) for i in range(n)]


def test_query_equals_its_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
        want = sorted(con.sql(f"SELECT {', '.join(NAMES)} FROM ({hard_negatives.ORACLE})").fetchall())
        assert want and got(hard_negatives.op12_hard_negatives(spark, str(Path("/root/testdata", sf)))) == want


def test_equals_all_pairs(spark):
    rows = clustered(400, 1)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    want = brute(rows, lambda i: i % 9 == 0)
    assert len(want) > 500
    for turn, tree in ((4_096, 512), (20, 7), (7, 1)):
        assert got(mine(df, F.col("vec_id") % 9 == 0, turn=turn, tree=tree)) == want


def test_bounds_save_scores_and_hold():
    rows = clustered(3_000, 2)
    x = np.array([np.floor(256 * np.array(v)) for _, _, v in rows])
    anchors = pa.table({"row": list(range(0, 3_000, 30)), "vec_id": list(range(0, 3_000, 30)), "label": [rows[i][1] for i in range(0, 3_000, 30)], "v": [x[i].astype(int).tolist() for i in range(0, 3_000, 30)]})
    (tree,) = spanning_trees(anchors)
    assert (tree.parent[1:] < np.arange(1, 100)).all() and tree.parent[0] == -1
    true = tree.x @ x.T
    least, most = np.quantile(true, 0.97), np.quantile(true, 0.98)
    seen = {}
    scored = descend(tree, x, np.ones((100, 3_000), bool), lambda i: (least, most), lambda i, at, s: seen.update({(i, j): v for j, v in zip(at.tolist(), s.tolist(), strict=True)}))
    assert seen == {(i, j): int(true[i, j]) for i, j in zip(*np.nonzero((true >= least) & (true <= most)), strict=True)}
    assert scored < 0.6 * true.size


def test_large_numbers_stay_exact(spark):
    rows = [(i, i % 2, [float(2**20 + i), float(3 * i) - 2**21, 0.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert got(mine(df, F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [0.5, 0.5]), (2, 2, [0.5, 0.0]), (2, 2, [0.5, 0.0]), (3, 2, [0.25, 1.0]), (0, 1, [0.9, 0.1]), (4, 2, [0.0, 0.0]), (5, 2, [1.0]), (0, 2, [1.0])]
    odd = [(6, 2, None), (6, None, [0.5, 0.0]), (None, 2, [0.5, 0.0]), (6, 2, [nan, 0.5]), (6, 2, [0.5, inf]), (6, 2, [None, 0.5]), (6, 2, [1e30, 0.0]), (6, 2, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in good + odd], "vec_id long, label int, embedding array<float>, row int, rank int")
    want = brute(good, lambda i: i == 0)
    assert want and got(mine(df, F.col("vec_id") == 0)) == want
    assert got(mine(df, F.lit(False))) == [] and got(mine(df.limit(0), F.lit(True))) == []
    zero = [(0, 1, [0.0]), (1, 1, [1.0]), (2, 2, [3.0]), (3, 2, [-3.0])]  # a positive of score 0 takes negatives of 0
    assert got(mine(spark.createDataFrame(zero, "vec_id long, label int, embedding array<float>"), F.col("vec_id") == 0)) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]
    less = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5])]
    assert got(mine(spark.createDataFrame(less, "vec_id long, label int, embedding array<float>"), F.col("vec_id") == 0)) == []
