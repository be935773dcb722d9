import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import toxicity
from lodestone.llm.toxicity import SPAN, Bags, SubwordModel, _mix, train


def subwords(word):
    """The n-grams of a word and its edges, as written."""
    edged = f" {word} "
    return [edged[i : i + k] for k in toxicity.ORDERS for i in range(len(edged) - k + 1)]


def bucket(gram):
    key = ord(gram[0])
    for c in gram[1:]:
        key = (key * 0x100000001B3 + ord(c)) % 2**64
    return int(_mix(np.array([key], np.uint64), len(gram))[0])


def whole_bucket(word):
    key = sum(ord(c) * pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k, c in enumerate(word)) % 2**64
    return int(_mix(np.array([key], np.uint64), 1)[0])


def plain_score(model, text):
    """Word by word and window by window."""
    words, said = "".join(c if c.isalnum() else " " for c in text.lower()).split(), []
    for i, w in enumerate(words):
        parts = [whole_bucket(w), *map(bucket, subwords(w))]
        said.append(0.0 if w in words[max(0, i - SPAN) : i] else sum(float(model.weight[b]) for b in parts) / len(parts))
    best = 0.0
    if words:
        starts = [s for s in range(0, len(words), SPAN // 2) if s == 0 or s + SPAN // 2 < len(words)]
        best = max(sum(said[s : s + SPAN]) / len(said[s : s + SPAN]) for s in starts)
    return 1 / (1 + np.exp(-(best + model.bias)))


def test_scores_equal_word_by_word(monkeypatch):
    rng = random.Random(1)
    model = SubwordModel(np.random.default_rng(1).normal(0, 9, toxicity.BUCKETS).astype(np.float32), -0.5)
    texts = ["", " ", "a", "A a a", "!?", "é ü", "x" * 300, "İstanbul ß 𝔘nd", "don't stop", *(" ".join(rng.choice(["foo", "bar7", "Straße", "x", "zwölf", "y-z", "…"]) + str(rng.randrange(9)) for _ in range(n)) for n in (1, 8, 9, 16, 17, 24, 25, 200))]
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-9)
    monkeypatch.setattr(toxicity, "BLOCK", 120)
    assert np.allclose(model.scores(texts[:-1]), want[:-1], atol=1e-9)  # texts in several blocks
    assert Bags(["Ab c", "", "d1!e"]).words() == ["ab", "c", "d1", "e"] and Bags(["Ab c", "", "d1!e"]).count.tolist() == [2, 0, 2]


def test_misspellings_are_found():
    rng = random.Random(2)
    common = ["".join(rng.choice("abdeghiklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["wretched", "imbecile", "dimwit"]

    def text(n, some):
        words = rng.choices(common, k=n)
        for w in some:
            words[rng.randrange(n)] = w
        return " ".join(words)

    rows = [(text(rng.randint(5, 300), rng.choices(bad, k=2) if i % 2 else []), i % 2) for i in range(500)]
    model = train(*map(list, zip(*rows, strict=True)))
    unseen = [text(200, [w]) for w in ("wretchedd", "imbeciles", "dimwitt", "wrretched", "imbecille", "xdimwit")]
    clean = model.scores([text(n, []) for n in (3, 50, 2_000) for _ in range(20)])
    assert model.scores(unseen).min() > clean.max() and clean.max() < 0.7 and np.median(model.scores(unseen)) > 0.7
    assert model.scores([""])[0] < 0.7


def test_held_out_documents(spark):
    base = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op11_toxicity(spark, base).collect()}
    docs = spark.read.parquet(f"{base}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{base}/labels.parquet").collect() if got[r.doc_id].held_out]
    toxic, clean = ([got[r.doc_id] for r in labels if r.toxic == t] for t in (1, 0))
    english = {r.doc_id for r in docs.where("lang = 'en'").collect()}
    # what marks the 129 toxic documents of other languages that teach is rare; check_l, with 10,000, is found to 0.999
    assert len(toxic) > 100 and np.mean([r.predicted for r in toxic]) > 0.75 and np.mean([r.predicted for r in toxic if r.doc_id in english]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.015
    assert np.mean(np.array([r.score for r in toxic])[:, None] > np.array([r.score for r in clean])) > 0.95


def test_labels_and_ids_are_no_inputs(spark):
    docs = spark.createDataFrame([(i, "you fool" if i % 2 else "good day") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, known, ~toxicity.held_out(F.col("doc_id")))).collect()} for known in (labels, turned)]
    assert scores[0] == scores[1] and len({scores[0][i] for i in range(0, 60, 2)}) == 1 and scores[0][1] > scores[0][0]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bad words here", "x"), (1, "other", "x"), (2, "good words here", "x"), (2, "good words here", "x"), (None, "bad words", "x"), (3, None, "x"), (4, "", "x"), (5, "?!", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, 1), (4, None), (9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, model).collect())
    assert len(got) == 8 and all(0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i in "345"}) == 1 and got[2] == got[3]
    one = toxicity.fit(docs, labels.where("toxic = 0 and doc_id <> 1"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {0.0}
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    few = toxicity.fit(docs, labels, F.lit(True), train_chars=1)
    assert toxicity.score(docs, few).count() == 8
    assert re.match("doc_id", toxicity.score(docs, model).columns[0])
