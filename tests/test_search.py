import numpy as np
import pytest

from lodestone.operators import search


@pytest.mark.parametrize("text_ids", [False, True])
def test_a_task_hands_on_its_nearest_only(spark, monkeypatch, text_ids):
    """However many blocks its rows are compared in, with ties, odd vectors and two lengths."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 3 if i % 7 else 2).astype(float).tolist()) for i in range(900)] + [(900, None), (901, [float("nan"), 1.0, 1.0]), (902, [])]
    named = [(f"{i % 10}/{i}" if text_ids else i, v) for i, v in rows]
    chunks = spark.createDataFrame(named, f"id {'string' if text_ids else 'long'}, embedding array<double>").repartition(3)
    asked = [(i, v) for i, v in rows[:900:20] if any(v)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {q: sorted((round(1 - float(unit(v) @ unit(w)), 9) + 0.0, i) for i, w in named if w and len(w) == len(v) and np.isfinite(w).all() and any(w))[:10] for q, v in asked}
    made = []
    nearest = search._nearest
    monkeypatch.setattr(search, "_nearest", lambda *a: made.append(nearest(*a)) or made[-1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for product, waiting, sent in ((4_000_000, 1 << 19, 1 << 17), (1_000, 5, 30)):
            for name, value in (("PRODUCT", product), ("WAITING", waiting), ("SENT", sent)):
                monkeypatch.setattr(search, name, value)
            got = {}
            for r in search.vector_topk(chunks, queries, 10).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((round(r.distance, 9) + 0.0, r.id))
            assert got == want
            assert made[-1].count() <= made[-1].rdd.getNumPartitions() * len(asked) * 10
        assert search.vector_topk(chunks.limit(0), queries, 10).count() == search.vector_topk(chunks, queries.limit(0), 10).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
