import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


def brute(library, text):
    return [len(library.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]


def counts(table):
    return [tc.tokens_in_prefix(table, i + 1) for i in range(len(table) // 2)]


CASES = ["", " ", "a", "it's we'll they've I'd 'r 're '", "foo\n\n  bar\t baz \n", "x  y   z    ", "\n a\n\n b", "naïve éclair ÀÉ 日本語 🙂🙂 ok",
         "a<|endoftext|>b  <|endoftext|> c<|endoftext|", "<|endoftext|><|endoftext|>", "1234567 12.5%%% &&&", "x y 　z \x1c w\x85v", "a" * 150, "-" * 200 + " " * 80 + "end", "!!'s !'re"]


@pytest.mark.parametrize("text", CASES)
def test_every_prefix(text):
    assert counts(tc.counter(PATH).tables([text])[0]) == brute(LIBRARY, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab cd'rsetlv\n\t é.1 日<| TheIN") , max_size=40))
def test_random_texts(text):
    assert counts(tc.counter(PATH).tables([text])[0]) == brute(LIBRARY, text)


def test_budget():
    t = tc.counter(PATH).tables(["The quick brown fox"])[0]
    assert tc.longest_prefix(t, 0) == 0
    assert tc.longest_prefix(t, 2) >= len("The quick")
    assert tc.longest_prefix(t, 99) == len("The quick brown fox")


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (1, "Hello world", "y"), (None, None, None), (3, "", "z")], "doc_id long, text string, n_tokens string")
    rows = tc.prefix_token_counts(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == [(0, 0, 0), (1, 11, 2), (1, 11, 2), (3, 0, 0)]
    assert tc.prefix_token_counts(df.limit(0), PATH).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = tc.op4_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(LIBRARY.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)
        text = docs[r.doc_id]
        count = lambda k: len(LIBRARY.encode(text[:k], add_special_tokens=False).ids)  # noqa: B023, E731
        assert r.prefix_chars == len(text) if n <= 512 and r.prefix_chars == len(text) else count(r.prefix_chars) <= 512 < count(min(len(text), r.prefix_chars + 1))
