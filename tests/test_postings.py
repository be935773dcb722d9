import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import identifiers as ident
from lodestone.operators import postings

RNG = random.Random(4)
WORDS = ["load_file", "loadFile", "LoadFile", "the", "MAX_SIZE", "tree", "Tree", "find", "x1", "naïve", "of", "reader"]
TEXTS = [(i, " ".join(RNG.choices(WORDS, k=RNG.randrange(12)))) for i in range(300)] + [(500, None), (501, ""), (70_000, "tree load_file"), (70_001, "loadFile"), (-3, "tree"), (None, "tree"), (7, "repeated MAX_SIZE")]
QUERIES = [(1, "find load_file and LoadFile"), (2, "a tree of readers"), (3, "the of"), (4, None), (5, "MAX_SIZE missing_name loadFile tree"), (6, "Tree Tree tree")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(TEXTS, "text_id long, content string"), spark.createDataFrame(QUERIES, "query_id int, query string")


def plain():
    out = {}
    for i, text in TEXTS:
        if i is None or text is None:
            continue
        for q, query in QUERIES:
            own = set(text.split())
            names = {w for w in (query or "").split() if w in ("load_file", "LoadFile", "MAX_SIZE", "missing_name", "loadFile")}
            words = {w.lower() for w in (query or "").split() if len(w) > 2} - set(ident.STOP_WORDS)
            m, has = len(names & own), bool(words & {w.lower() for w in own})
            if m or has:
                old = out.get((q, i), (0, False))
                out[q, i] = (m + old[0], has or old[1])
    return out


def test_lists_are_whole(spark, tables):
    texts, _ = tables
    made = postings.build(texts, block=64)
    rows = made.collect()
    ids = {}
    for r in rows:
        assert r.gaps[0] == 0 and r.n == len(r.gaps) and r.first + sum(r.gaps) == r["last"] and r.first // 64 == r["last"] // 64 == r.block
        at = r.first
        for g in r.gaps:
            at += g
            ids.setdefault((r.lower, r.word), set()).add(at)
    want = {}
    for i, t in TEXTS:
        for w in (t or "").split() if i is not None else ():
            want.setdefault((False, w), set()).add(i)
            want.setdefault((True, w.lower()), set()).add(i)
    assert ids == want


def test_scores(spark, tables, tmp_path, monkeypatch):
    texts, queries = tables
    postings.write(postings.build(texts, block=64), str(tmp_path / "lists"))
    lists = spark.read.parquet(str(tmp_path / "lists"))
    asked = postings.asked_words(queries)
    want = plain()
    want.pop((1, 7), None), want.pop((5, 7), None)  # the id of two texts
    want = {k: v for k, v in want.items() if k[1] != 7}
    for limit in (100_000, 0):
        monkeypatch.setattr(postings, "BROADCAST_WORDS", limit)
        for found in (postings.texts_with(lists, asked), postings.scan(texts.where("text_id is not null"), asked)):
            got = {(r.query_id, r.text_id): (r.matches, r.has_word) for r in postings.score(found, queries).collect() if r.text_id != 7}
            assert got == want
    some = {r.text_id for r in postings.texts_with(lists, asked, low=100, high=70_000).collect()}
    assert some == {i for _, i in want if 100 <= i <= 70_000}
    boosts = {r.boost for r in postings.score(postings.texts_with(lists, asked), queries).collect()}
    assert boosts <= {1.0, 1.2, 3.0, 4.5, 6.0} and {1.0, 1.2, 3.0, 4.5} <= boosts


def test_empty(spark, tables):
    texts, queries = tables
    lists = postings.build(texts.limit(0))
    assert lists.count() == 0 and postings.texts_with(lists, postings.asked_words(queries)).count() == 0
    assert postings.texts_with(postings.build(texts), postings.asked_words(queries.limit(0))).count() == 0


def test_boost_is_that_of_identifiers(spark):
    df = spark.createDataFrame([(q, t) for q in ("load_file loadFile x_y", "plain words", "of the") for t in ("load_file", "load_file loadFile x_y", "words", "none")], "q string, t string")
    names, words = ident.identifiers(F.col("q")), ident.significant_words(F.col("q"))
    own = ident.words_of(F.col("t"))
    rows = df.select(ident.boost(names, words, F.col("t")).alias("a"), postings.boost(F.size(names) > 0, ident.identifier_matches(names, own), ident.has_significant_word(words, ident.words_of(F.lower("t")))).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_scores_of_lists_group_no_pairs(spark, tables, monkeypatch, limit):
    texts, queries = tables
    monkeypatch.setattr(postings, "BROADCAST_WORDS", limit)
    monkeypatch.setattr(postings, "PAIRS", 50)
    lists = postings.build(texts, block=64)
    rows = lambda found: sorted(map(tuple, found.select("query_id", "text_id", "matches", "has_word", "boost").collect()))
    want = rows(postings.score(postings.texts_with(lists, postings.asked_words(queries)), queries))
    for batch in (10_000, 3):  # a block in one batch and in several
        monkeypatch.setattr(postings, "_counted", lambda batches, batch=batch, own=postings._counted: own(b.slice(s, batch) for b in batches for s in range(0, b.num_rows, batch)))
        found = postings.score_lists(lists, queries)
        assert rows(found) == want and len(want) > 300
        # neither a hash nor a sort grows with the pairs
        assert "keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert postings.score_lists(lists, queries.limit(0)).count() == 0 and postings.score_lists(postings.build(texts.limit(0)), queries).count() == 0


def test_lists_are_made_of_short_ones(spark, monkeypatch):
    """Words are grouped where texts are taken apart, and the lists of lower-cased words come from those as they stand: equal to
    lists from each text's words, with letters whose lower case depends on their place or is longer."""
    rng = random.Random(8)
    some = ["Find", "find", "FIND", "ΟΔΟΣ", "οδος", "οδοσ", "Σ", "ΑΣ'Α", "İx", "i̇x", "ẞ", "x_1", "X_1", "", "Ǆ", "é", "!"]
    rows = [(rng.randrange(-200, 400), " ".join(rng.choices(some, k=rng.randrange(9)))) for _ in range(500)] + [(2**40 + 1, "Find ΑΣ'Α"), (9, None), (None, "find")]
    texts = spark.createDataFrame(rows, "text_id long, content string").repartition(3)
    want = {}
    for r in postings.words_of_texts(texts.where("text_id is not null")).collect():
        want.setdefault((r.lower, r.word), set()).add(r.text_id)
    for together, batch in ((2_000_000, 10_000), (40, 3)):
        monkeypatch.setattr(postings, "TOGETHER", together)
        merged = postings._whole
        monkeypatch.setattr(postings, "_whole", lambda batches, *by, batch=batch, own=merged: own((b.slice(s, batch) for b in batches for s in range(0, b.num_rows, batch)), *by))
        made = postings.build(texts, block=64)
        got = {}
        for r in made.collect():
            assert r.gaps[0] == 0 and r.n == len(r.gaps) and r.first + sum(r.gaps) == r["last"] and r.first // 64 == r["last"] // 64 == r.block
            ids = {r.first + sum(r.gaps[: k + 1]) for k in range(r.n)}
            assert not ids & got.get((r.lower, r.word), set()) and len(ids) == r.n
            got.setdefault((r.lower, r.word), set()).update(ids)
        assert got == want
        monkeypatch.setattr(postings, "_whole", merged)
    assert "collect_set" not in made._jdf.queryExecution().executedPlan().toString()


def test_more_texts_take_more_tasks(spark, tables, monkeypatch):
    """So that what a task sorts does not grow with the texts where a session has few tasks for shuffles."""
    texts, _ = tables
    monkeypatch.setattr(postings, "TEXTS", 30)
    made = postings.build(texts, block=64)
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString() and made.rdd.getNumPartitions() == -(-len(TEXTS) // 30)
    whole = lambda lists: sorted(map(str, lists.collect()))
    got = whole(made)
    monkeypatch.setattr(postings, "TEXTS", 8_192)
    assert got == whole(postings.build(texts, block=64))
