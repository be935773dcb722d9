import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import sentencepieces as sp

PATH = public_tokenizers.path(sp.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(text):
    import numpy as np

    return np.frombuffer(sp.encoder(PATH).encode([text])[0], "<i4").tolist()


def decode(ids):
    import numpy as np

    return sp.decoder(PATH).decode(np.array(ids, np.int32), np.array([len(ids)]))[0]


CASES = ["", " ", "   ", "Hello world", "  a  b\n c\t d ", "naïve ÀÉ 日本語 🙂🙂ก", "a" * 200, " " * 70 + "x", "▁▁x ▁", "x yﬁ", "<s></s><unk><0x41>", "\n\n\n", "aaaa bbbb aaaaaaa", "12345 3.14%%% ***"]


@pytest.mark.parametrize("text", CASES)
def test_equals_library(text):
    assert ids(text) == LIBRARY.encode(text)
    assert decode(ids(text)) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(st.sampled_from("ab the in\n▁ é日"), max_size=40))
def test_random_texts(text):
    if "\x00" in text:
        text = text.replace("\x00", "")
    assert ids(text) == LIBRARY.encode(text)
    assert decode(ids(text)) == LIBRARY.decode(LIBRARY.encode(text))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in sp.decode_pieces(sp.encode_pieces(docs, PATH), PATH).join(docs, "doc_id").collect():
        assert list(r.ids) == LIBRARY.encode(r.text) and r.decoded == r.text
    assert all(r.decoded == r.text for r in sp.encode_pieces(docs, PATH, decode=True).join(docs, "doc_id").collect())


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (None, None, 7)], "doc_id long, text string, ids int")
    rows = sp.encode_pieces(df, PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in rows) == [(0, 0), (1, 2), (1, 2)]
    assert sp.encode_pieces(df.limit(0), PATH).count() == 0
    some = sp.decode_pieces(spark.createDataFrame([(1, None), (2, [1, 263, 2]), (3, [])], "doc_id long, ids array<int>"), PATH).collect()
    assert {r.doc_id: r.decoded for r in some} == {1: None, 2: LIBRARY.decode([1, 263, 2]), 3: ""}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = sp.op6_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        true = LIBRARY.encode(docs[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(true), zlib.crc32(np.array(true, "<u4").tobytes()))
        assert (r.n_chars, r.text_sha256) == (len(LIBRARY.decode(true)), hashlib.sha256(LIBRARY.decode(true).encode()).hexdigest())
