import pytest
from pyspark.sql import functions as F

from lodestone.functions import identifiers as ident
from lodestone.functions import text as tx
from lodestone.functions.vectors import cosine_distance
from lodestone.operators import search


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(*columns).head()


@pytest.mark.parametrize("query, names", [
    ("where is validateUserToken and UserValidator", {"validateUserToken", "UserValidator"}),
    ("get_user_by_id MAX_RETRIES HTTP plain words", {"get_user_by_id", "MAX_RETRIES", "HTTP"}),
    ("user User USER u_ _x", {"USER"}),
    ("", set()),
    ("naïveCase éfoo_bar", set()),
])
def test_identifiers(spark, query, names):
    assert set(one(spark, ident.identifiers(F.col("q")), q=query)[0]) == names


def test_significant_words(spark):
    got = one(spark, ident.significant_words(F.col("q")), q="How does the Éclair function work, with I/O in ab abc abc?")[0]
    assert got == ["éclair", "work", "abc"]


def test_boost_grows_with_matches(spark):
    q = "readFile WriteFile MAX_SIZE"
    factor = lambda text: one(spark, ident.boost(ident.identifiers(F.col("q")), ident.significant_words(F.col("q")), F.col("t")), q=q, t=text)[0]
    assert [factor(t) for t in ("nothing", "readFile()", "readFile WriteFile", "readFile WriteFile MAX_SIZE", "readFiles")] == [1.0, 3.0, 4.5, 6.0, 1.0]
    plain = lambda text: one(spark, ident.boost(ident.identifiers(F.col("q")), ident.significant_words(F.col("q")), F.col("t")), q="parse token", t=text)[0]
    assert [plain("a Token here"), plain("tokens")] == [1.2, 1.0]
    assert one(spark, ident.has_exact_match(ident.identifiers(F.col("q")), ident.words_of(F.col("t")), case_sensitive=False), q=q, t="READFILE")[0]


def test_context_and_display(spark):
    row = one(spark, tx.rerank_context(F.col("p"), F.lit(""), F.lit("run"), F.lit("x")), tx.displayed(F.col("long")), tx.line_number(F.col("lines"), F.lit(3)), p=None or "a.py", long="y" * 800, lines="a\nb\nc")
    assert row[0] == "File: a.py | Function: run | Code: x" and row[1] == "y" * 600 + "…" and row[2] == 2


def test_cosine(spark):
    assert one(spark, cosine_distance(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0])[0] == pytest.approx(1 - 0.5**0.5)
    assert one(spark, cosine_distance(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0])[0] is None


def test_fetch_size():
    assert [search.fetch_size(5), search.fetch_size(5, rerank_multiplier=3), search.fetch_size(5, True), search.fetch_size(6, True, 2)] == [5, 15, 50, 120]


def test_topk_of_few_rows_and_rerank(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0, 0.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0])], "query_id int, embedding array<float>")
    got = search.vector_topk(chunks, queries, 10).collect()
    assert [(r.id, r["rank"]) for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 1] == [("a", 1), ("e", 2), ("b", 3)]
    hits = spark.createDataFrame([(1, 1, "a", 0.3), (1, 2, "b", 0.9), (1, 3, "c", 0.5), (1, 4, "d", 0.5)], "query_id int, rank int, id string, s double")
    assert [r.id for r in search.rerank(hits, F.col("s"), 3).orderBy("rank").collect()] == ["b", "c", "d"]


def test_unstrict_limit_leaves_queries_without_identifiers_whole(spark):
    rows = [(q, k, f"{q}{k}", "readFile" if k == 7 else "text", 1 - k / 10, query) for q, query in ((1, "plain words"), (2, "readFile")) for k in range(1, 8)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, id string, content string, similarity double, query string")
    got = search.boost_hits(hits, F.col("query"), 3, strict_limit=False).collect()
    assert len([r for r in got if r.query_id == 1]) == 7 and not any(r.boosted or r.original_similarity for r in got if r.query_id == 1)
    top = sorted((r["rank"], r.id, r.boosted) for r in got if r.query_id == 2)
    assert top[0] == (1, "27", True) and len(top) == 3
    assert search.boost_hits(hits, F.col("query"), 3).count() == 6
