"""An embedding model that is fitted on the texts themselves.

A text is a bag of its words and of the three letters in a row of them, signed by one hash and put into ``BUCKETS`` by
another, damped by the logarithm and weighted by how rare a bucket is. A randomised singular value decomposition brings that
down to ``DIMENSION`` numbers: every pass over the texts multiplies the Gram matrix with a few columns, task by task, and Spark sums
what the tasks have. So texts that share rare words and word parts lie near each other, whatever their frequent ones are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import one_line
from ..sources.scratch import discard, materialize

BUCKETS, DIMENSION = 4_096, 64
#: Columns beside the wanted ones, and further passes that sharpen the subspace.
OVER, PASSES = 16, 1
#: Rows of a sum that meet in one group.
STRIPE = 256
#: Texts of which features are dense at once.
ROWS = 256

_WORD = np.array([chr(i).isalnum() for i in range(0x10000)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def features(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Signed counts, damped, a row a text."""
    code = np.frombuffer((" " + " ".join(t.lower() for t in texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    word = (code > 0xFFFF) | _WORD[np.minimum(code, 0xFFFF)]
    owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])
    owner = np.r_[0, owner]
    c = np.where(word, code, 32).astype(np.uint64)
    # three letters in a row, the first and last of which may be the edge of a word
    triple = (c[:-2] * np.uint64(0x100000001B3) + c[1:-1]) * np.uint64(0x100000001B3) + c[2:]
    key, own = [_mix(triple[word[1:-1]])], [owner[1:-1][word[1:-1]]]
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if len(start):
        at = np.arange(len(c)) - np.maximum.accumulate(np.where(word & np.r_[True, ~word[:-1]], np.arange(len(c)), 0))
        power = np.cumprod(np.full(int(at[word].max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        each = np.zeros(len(c), np.uint64)
        each[word] = c[word] * power[at[word]]
        key.append(_mix(np.add.reduceat(each, start) + np.uint64(1)))
        own.append(owner[start])
    key, own = np.concatenate(key), np.concatenate(own)
    sign = np.where(key >> np.uint64(63), 1.0, -1.0)
    total = np.bincount(own * buckets + (key % np.uint64(buckets)).astype(np.int64), sign, len(texts) * buckets).reshape(len(texts), buckets)
    return np.sign(total) * np.log1p(np.abs(total))


def _weighted(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = x * weight
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


class TextModel:
    """``weight`` of each bucket, and ``axes``, a column for each number of an embedding."""

    def __init__(self, weight: np.ndarray, axes: np.ndarray):
        self.weight, self.axes = weight, axes

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Unit vectors; zeros for a text without words."""
        out = np.zeros((len(texts), self.axes.shape[1]))
        for k in range(0, len(texts), ROWS):
            v = _weighted(features(texts[k : k + ROWS], len(self.weight)), self.weight) @ self.axes
            out[k : k + ROWS] = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
        return out

    def embed(self, rows: DataFrame, text_col: str = "content") -> DataFrame:
        """``rows`` with a column ``embedding``: as ``Index`` takes it. Texts without words, nulls too, have a null."""
        shared = rows.sparkSession.sparkContext.broadcast(self)  # BUCKETS * DIMENSION numbers
        names = rows.columns
        schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = shared.value.vectors([t or "" for t in b.column(text_col).to_pylist()])
                size = v.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, size, dtype=np.int32)), pa.array(v.ravel().astype(np.float32)), mask=pa.array(~v.any(1)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), lists], [*names, "embedding"])

        return rows.mapInArrow(run, schema)


def _summed(texts: DataFrame, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], buckets: int) -> np.ndarray:
    """The sum over all texts of what ``of`` makes of their features. Each task adds up its own; stripes of the tasks' sums
    meet in groups, and the result, of a fixed size, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                total += of(features(b.column(0).slice(k, ROWS).to_pylist(), buckets))
        stripes = [total[k : k + STRIPE].tobytes() for k in range(0, shape[0], STRIPE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(stripes)), pa.int32()), pa.array(stripes, pa.binary())], ["stripe", "part"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(len(rows["part"][0].as_py()) // 8)
        for part in rows["part"]:
            total += np.frombuffer(part.as_py())
        return pa.table([rows["stripe"].slice(0, 1), pa.array([total.tobytes()])], ["stripe", "part"])

    found = texts.mapInArrow(run, "stripe int, part binary").groupBy("stripe").applyInArrow(add, "stripe int, part binary").toArrow().sort_by("stripe")
    out = np.zeros(shape) if not found.num_rows else np.frombuffer(b"".join(found["part"].to_pylist())).reshape(shape)
    return out


def fit(rows: DataFrame, text_col: str = "content", dimension: int = DIMENSION, buckets: int = BUCKETS, seed: int = 5) -> TextModel:
    """Fit on all texts of ``rows``; null and empty ones teach nothing. With fewer directions than ``dimension`` in the texts, the
    other numbers are 0. The same texts give the same model but for the order in which sums are rounded."""
    texts = materialize(rows.select(one_line(F.col(text_col)).alias("text")).where("text IS NOT NULL"))
    n = texts.count()
    seen = _summed(texts, lambda x: (x != 0).sum(0, keepdims=True).T.astype(float), (buckets, 1), buckets)[:, 0]
    weight = np.log((1 + n) / (1 + seen))
    wide = min(buckets, dimension + OVER)
    q = np.random.default_rng(seed).normal(size=(buckets, wide))
    for _ in range(1 + PASSES):
        q = np.linalg.qr(_summed(texts, lambda x, q=q: (w := _weighted(x, weight)).T @ (w @ q), (buckets, wide), buckets))[0]
    small = _summed(texts, lambda x, q=q: (y := _weighted(x, weight) @ q).T @ y, (wide, wide), buckets)
    discard(texts)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:dimension]
    axes = q @ turn[:, order]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1) * (values[order] > 1e-9 * max(values.max(), 1e-300))
    return TextModel(weight, np.pad(axes, ((0, 0), (0, dimension - axes.shape[1]))))
