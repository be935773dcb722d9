"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, html_text, language_id, near_dedup, nearest, periodic_runs, queries, sentencepieces, substring_dedup, token_counts, token_files, toxicity, url_filter

#: Names that operators give their own columns.
CLASHING = ("id", "id_", "text_", "t1", "t2", "t1_", "t2_", "has_letter", "has_letter_", "hit_id", "hit_id_", "keep_id_", "own_id", "words_of", "first_id", "class_id", "lost", "label", "bucket", "words", "item", "place", "seed",
            "leaf", "row", "rank", "score", "path", "host", "page_host", "tie", "range", "bin", "start", "ids")
CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT = "The cat and the dog sat on the mat with the other animals of the house while it was raining outside. "
LONG = " ".join(f"{w}{i % 977}" for i, w in enumerate(TEXT.split() * 3_000))
ROWS = [(1, TEXT, "en"), (2, TEXT, "en"), (2, TEXT, "en"), (3, None, None), (None, TEXT + "It went on.", "en"), (4, "", "en"), (5, " \n\t", None), (6, LONG, "en"), (7, LONG + " end", None), (8, "x", "de"),
        (9, "Der Hund und die Katze sitzen auf der Matte mit den anderen Tieren des Hauses, und draußen regnet es sehr. " * 4, "de"), (10, "a" * 100_000, None), (11, "12 34 !?", "en"), (None, None, None), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame([(i, t, lang, None if i is None else f"s{i % 2}", None if t is None else len(t)) for i, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return made.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "sat on the mat with the other animals of the house while it was", "z"), (2, None, "z"), (None, "no such words here", "z"), (3, "", "z")], "item_id long, text string, doc_id string")


WHOLE = {
    "language": lambda docs, items: language_id.keep_known_languages(docs),
    "near": lambda docs, items: near_dedup.one_of_each(docs),
    "substring": lambda docs, items: substring_dedup.without_repeats(docs),
    "benchmark": lambda docs, items: decontaminate.without_contaminated(docs, items),
}


@pytest.mark.parametrize("name", list(WHOLE))
def test_all_columns_stay(spark, docs, items, name):
    before = spark.conf.get(CONF)
    kept = WHOLE[name](docs, items)
    rows = kept.collect()
    assert spark.conf.get(CONF) == before and kept.columns == docs.columns
    assert all(r[c] == (None if r.doc_id is None else f"{c} {r.doc_id}") for r in rows for c in CLASHING)
    found = sorted((r.doc_id for r in rows if r.doc_id is not None))
    assert found == {"language": [1, 2, 2, 6, 7, 9], "near": [1, 3, 6, 8, 9, 10, 11], "substring": [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], "benchmark": [3, 4, 5, 6, 7, 8, 9, 10, 11]}[name]
    if name == "substring":
        assert {r.doc_id: r.text for r in rows if r.doc_id in (2, 3, 4, 7)} == {2: "", 3: None, 4: "", 7: "end"}
    empty = WHOLE[name](docs.limit(0), items.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


ROW_FOR_ROW = {
    "op1": lambda docs, spark: language_id.identify(docs, language_id.fit(docs, F.lit(True))),
    "op4": lambda docs, spark: token_counts.prefix_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=3),
    "op5": lambda docs, spark: substring_dedup.remove_repeats(docs),
    "op6": lambda docs, spark: sentencepieces.encode_pieces(docs, public_tokenizers.path(sentencepieces.MODEL), decode=True),
    "op7": lambda docs, spark: near_dedup.near_groups(docs),
    "op8": lambda docs, spark: decontaminate.contamination(docs, spark.createDataFrame([(7, "cat and the dog sat")], "item_id long, text string")),
    "op11": lambda docs, spark: toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(1, 0), (8, 1), (9, 1), (10, 0)], "doc_id long, toxic int"), F.lit(True))),
    "op13": lambda docs, spark: periodic_runs.find_runs(docs, planted=True),
    "stage5": lambda docs, spark: corpus_pipeline.encode(spark, docs, ""),
}


@pytest.mark.parametrize("name", list(ROW_FOR_ROW))
def test_a_row_for_every_row(spark, docs, name):
    before = spark.conf.get(CONF)
    got = [r.doc_id for r in ROW_FOR_ROW[name](docs, spark).collect()]
    assert sorted(got, key=repr) == sorted((r[0] for r in ROWS), key=repr) and spark.conf.get(CONF) == before
    assert ROW_FOR_ROW[name](docs.limit(0), spark).count() == 0


def test_token_files(spark, docs, tmp_path):
    before = spark.conf.get(CONF)
    token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/a")
    assert token_files.read_tokens(spark, f"{tmp_path}/a").count() == len(ROWS) and spark.conf.get(CONF) == before


def test_pages_and_vectors(spark):
    more = [F.lit(c).alias(c) for c in CLASHING]
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.example.com/x", "<p>text"), (1, "no host", ""), (2, "http://a.example.com/x", "<div>" * 3_000 + "deep")], "page_id long, url string, html string").select("*", *more)
    got = html_text.main_text(pages.drop("html_")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "text"), (1, ""), (1, ""), (2, "deep")]
    assert html_text.main_text(pages.limit(0)).count() == 0
    vectors = spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (None, [1.0, 2.0])], "vec_id long, embedding array<float>").select("*", *more)
    assert [(r.query_id, r.vec_id, r.score) for r in nearest.search(vectors, F.col("vec_id") == 100).collect()] == [(100, 1, 0.0)]


def test_pipeline_on_odd_and_empty_tables(spark, docs, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    items.write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in rows} >= {6, 9} and 1 not in {r.doc_id for r in rows}  # 1 has the benchmark's words
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_registered(spark):
    assert len(queries.QUERIES) == 13 and set(queries.ORACLE_SQL) == {"op5_substring_dedup", "op8_decontaminate", "op9_url_filter", "op12_hard_negatives"}
    assert all(f.__doc__ for f in queries.QUERIES.values()) and all(f.__doc__ for _, f in corpus_pipeline.STAGES)
    assert url_filter.op9_url_filter(spark, "/root/testdata/sf0.001").count() == 50
