import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=2000), st.data())
def test_codes(values, data):
    codes = tf.Codes(tf.write_codes(np.array(values, np.uint32)))
    assert codes.slice(0, len(values)).tolist() == values
    if values:
        i = data.draw(st.integers(0, len(values) - 1))
        j = data.draw(st.integers(i, len(values)))
        assert codes[i] == values[i] and codes.slice(i, j).tolist() == values[i:j]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(st.sampled_from("ab 'sreTHE.\n\t́é!<|endoftext>"), max_size=40))
def test_words_equal_whole_text(text):
    for t in (text, text + "<|endoftext|> x"):
        assert np.frombuffer(tf.tokenizer(PATH).encode([t])[0], "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def brute(rows):
    out, start = [], 0
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, monkeypatch):
    got = tf.op3_token_files(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == brute([(d.doc_id, d.text) for d in docs])


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "x", 1), (2, None, 1), (2, "same", 1), (2, "same", 2), (1, "", 3)], "doc_id long, text string, start int")
    tf.write_tokens(df, PATH, f"{tmp_path}/a")
    got = sorted(((r.start, r.n_tokens, r.doc_id) for r in tf.read_tokens(spark, f"{tmp_path}/a").collect()))
    assert [g[2] for g in got][:2] == [None, 1] and sum(g[1] for g in got) == got[-1][0] + got[-1][1] == 8
    tf.write_tokens(df.limit(0), PATH, f"{tmp_path}/b")
    assert tf.read_tokens(spark, f"{tmp_path}/b").count() == 0


def test_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SHARD_IDS", 5_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tf.write_tokens(docs, PATH, f"{tmp_path}/a")
    ids = [i for r in docs.orderBy("doc_id").collect() for i in [*LIBRARY.encode(r.text, add_special_tokens=False).ids, 2]]
    n = len(ids)
    asked = [(0, 0, 1), (1, 17, 18), (2, 4_990, 12_345), (3, n - 1, n + 99), (4, -5, 3), (5, n, n + 1), (6, 8, 8), (7, 0, n), (8, None, 5), (9, n // 2, n // 2 + 1)]
    got = {r.range_id: list(r.ids) for r in tf.read_ranges(spark, f"{tmp_path}/a", spark.createDataFrame(asked, "range_id long, start long, stop long")).collect()}
    assert got == {i: ids[max(a, 0) : b] for i, a, b in asked if a is not None and ids[max(a, 0) : b]}
