import math

from pyspark.sql import functions as F

from lodestone.operators import embedding, interaction, search


def triples(w):
    e = f" {w} "
    return {e[i : i + 3] for i in range(len(w))}


def plain(query_words, texts, text):
    """The score, word by word."""
    n = {w: max(1, sum(w in t.lower().split() for t in texts if t)) for w in query_words}
    weight = {w: math.log(1 + len(texts) / n[w]) for w in query_words}
    like = lambda a, b: len(triples(a) & triples(b)) / math.sqrt(len(triples(a)) * len(triples(b)))
    words = set((text or "").lower().split())
    total = sum(weight.values())
    return sum(weight[w] * max((like(w, v) for v in words), default=0) for w in query_words) / total if total else 0.0


TEXTS = ["load the reader", "Loaded readers of files", "nothing here", "", None, "load load load", "x", "reader"]
QUERIES = {1: ["load", "reader"], 2: [], 3: ["fiels", "nothing"], 4: ["missing"]}


def test_scores(spark):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")
    queries = spark.createDataFrame([(1, "load the reader"), (2, "the of"), (3, "fiels nothing"), (4, "missing")], "query_id int, query string")
    hits = chunks.crossJoin(queries.select("query_id")).withColumn("weights", F.lit("own"))
    for few in (True, False):
        rows = interaction.with_interaction(hits, interaction.word_weights(chunks, queries), few=few).collect()
        assert len(rows) == 32 and all(r.weights == "own" for r in rows)
        for r in rows:
            assert abs(r.score - plain(QUERIES[r.query_id], TEXTS, r.content)) < 1e-9
    best = {r.id: r.score for r in rows if r.query_id == 1}
    assert best[0] == 1.0 and best[1] > best[2] and best[4] == 0.0


def test_search_takes_it(spark):
    texts = ["a file that was loaded by some reader", "load the file with a reader", "other words entirely", "the file loader", "reader"]
    chunks = embedding.with_hash_embedding(spark.createDataFrame([(f"f{i}:chunk_0", f"f{i}", 0, 1, 1, t) for i, t in enumerate(texts)], "id string, file_path string, chunk_index int, start_line int, end_line int, content string"))
    queries = embedding.with_hash_embedding(spark.createDataFrame([(1, "load reader"), (2, "entirely")], "query_id int, query string"), "query")
    found = search.search(chunks, queries, n=2, rerank_words=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"]) for r in found] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert found[0].id == "f1:chunk_0" and found[0].similarity == 1.0 and found[2].id == "f2:chunk_0"
    assert "score" not in search.search(chunks, queries, n=2, rerank_words=True).columns
