import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import language_id as li


def test_held_out_accuracy(spark):
    rows = li.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    judged = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in judged)
    assert right / len(judged) > 0.97


def test_odd_rows(spark):
    text = "the cat and the dog sat on the mat with the other animals of the house "
    df = spark.createDataFrame(
        [(1, text, "en", "a"), (2, "der hund und die katze sitzen auf der matte mit den anderen tieren", "de", "b"), (3, None, "en", None),
         (4, "", None, None), (5, "12 34 !?", "en", None), (1, text, "en", "a"), (None, text * 3000, None, "c"), (7, "a", None, None)],
        "doc_id long, text string, lang string, score string")
    model = li.fit(df, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(df, model).collect()}
    assert li.identify(df, model).count() == 8
    assert got[1][0] == got[None][0] == "en" and got[2][0] == "de"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert {r.doc_id for r in li.keep_known_languages(df).collect()} >= {1, None}
    assert li.keep_known_languages(df).columns == df.columns
    nothing = li.fit(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in li.identify(df, nothing).collect()} == {"und"}
    assert li.identify(df.limit(0), model).count() == 0


def test_many_languages_share_slots():
    names = [f"l{i:02}" for i in range(20)]
    rng = np.random.default_rng(0)
    grams = {n: rng.integers(0, 2**63, 5000).astype(np.uint64) for n in names}
    f = li.BitmaskFilter(names, grams)
    assert f.slots.shape[1] == 3 and (f.false_rate < 0.01).all()


def test_filter_equals_sets():
    """Against sets of n-grams without any filter: the corrected shares are near the true ones, and winners agree."""
    import random

    rng = random.Random(2)
    words = {name: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(900)] for name in ("a1", "b2", "c3", "d4")}
    known = {name: {order: {int(k) for _, key in li._grams([" ".join(w)], order) for k in key} for order in li.ORDERS} for name, w in words.items()}
    model = li.BitmaskFilter(list(known), {name: np.array(sorted(set().union(*some.values())), np.uint64) for name, some in known.items()})
    texts = [" ".join(rng.choices(words[name], k=60) + rng.choices(words[other], k=rng.randrange(20))) for name in words for other in words for _ in range(10)]
    got = model.shares(texts)
    for text, shares in zip(texts, got, strict=True):
        keys = [int(k) for order in li.ORDERS for _, key in li._grams([text], order) for k in key]
        every = [set().union(*known[name].values()) for name in known]
        true = np.array([sum(k in s for k in keys) / len(keys) for s in every])
        assert abs(true - shares).max() < 0.03 and true.argmax() == shares.argmax()
