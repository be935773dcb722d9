import random

import numpy as np
import pytest

from lodestone.operators import search, text_model

RNG = random.Random(2)
WORDS = ["".join(RNG.choice("abcdefghiklmnoprstuvw") for _ in range(RNG.randint(2, 8))) for _ in range(600)]


def text(n):
    return " ".join([*RNG.choices(WORDS[:20], k=n), *RNG.choices(WORDS[20:], k=n)])


def near(t):
    words = t.split()
    for _ in range(len(words) // 8):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return " ".join(words)


TEXTS = [text(RNG.randint(10, 60)) for _ in range(150)]
COPIES = [near(t) for t in TEXTS[:40]]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + COPIES)] + [(900, None), (901, ""), (902, "?!")]
    df = spark.createDataFrame(rows, "id long, content string").repartition(3)
    return df, text_model.fit(df, dimension=16, buckets=512)


def test_features():
    x = text_model.features(["Ab c", "", "ab", "a-b  c"], 64)
    assert x.shape == (4, 64) and not x[1].any() and (x[0] != x[2]).any()
    assert np.allclose(text_model.features(["a-b  c"], 64)[0], x[3]) and np.allclose(text_model.features(["AB C", "ab c"], 64), x[0])
    assert np.allclose(np.exp(np.abs(text_model.features(["zz"] * 2, 64))) - 1, np.round(np.exp(np.abs(text_model.features(["zz"] * 2, 64))) - 1))


def test_equals_numpy(model):
    _, made = model
    x = text_model.features(TEXTS + COPIES + ["", "?!"], 512)
    weight = np.log((1 + len(x)) / (1 + (x != 0).sum(0)))
    assert np.allclose(made.weight, weight)
    x = text_model._weighted(x, weight)
    true = np.linalg.svd(x, compute_uv=False)
    got = np.sqrt(np.maximum(np.linalg.eigvalsh(made.axes.T @ x.T @ x @ made.axes), 0))[::-1]
    assert np.allclose(made.axes.T @ made.axes, np.eye(16), atol=1e-8)
    assert (got <= true[:16] + 1e-9).all() and got[0] > 0.999 * true[0] and got.sum() > 0.93 * true[:16].sum()


def test_the_seed_is_fixed(model):
    df, made = model
    again = text_model.fit(df, dimension=16, buckets=512)
    assert np.allclose(made.axes, again.axes, atol=1e-6)


def test_finds_near_copies(spark, model):
    df, made = model
    chunks = made.embed(df)
    assert {r.id for r in chunks.where("embedding is null").collect()} == {900, 901, 902} and chunks.columns == ["id", "content", "embedding"]
    queries = chunks.where(f"id >= {len(TEXTS)} and id < 900").select("id", "embedding").withColumnRenamed("id", "query_id")
    found = {r.query_id: r.id for r in search.vector_topk(chunks.where(f"id < {len(TEXTS)}"), queries, 1).collect()}
    assert len(found) == 40 and sum(found[len(TEXTS) + k] == k for k in range(40)) >= 39


def test_little_to_learn_from(spark):
    df = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, None)], "id long, content string")
    made = text_model.fit(df, dimension=4, buckets=32)
    assert made.axes.shape == (32, 4) and np.isfinite(made.axes).all()
    empty = text_model.fit(df.limit(0), dimension=4, buckets=32)
    assert {r.embedding for r in empty.embed(df).collect()} == {None}
