"""Embeddings of texts.

``Embedder`` is what a model must offer; ``embed`` runs one inside Arrow-batched tasks, loaded once a worker.
``hash_embed`` needs no model: words are counted into buckets of a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import unused
from ..functions.text import one_line, with_prefix

DIMENSION = 64
BATCH = 32


class Embedder(Protocol):
    dimension: int
    query_prefix: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def embed(rows: DataFrame, load: Callable[[], Embedder], text_col: str = "content", query: bool = False, batch: int = BATCH) -> DataFrame:
    """``rows`` with a column ``embedding``. ``load`` makes the model, once for each task's worker.

    Newlines count as spaces; queries get the model's prefix. A null text has a null embedding.
    """
    text: Column = one_line(F.col(text_col))
    names, (own,) = rows.columns, unused(rows, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            texts = b.column(own).to_pylist()
            found: list = [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(known), batch):
                some = known[k : k + batch]
                asked = [(model.query_prefix + texts[i]) if query else texts[i] for i in some]
                for i, v in zip(some, model.embed_batch(asked), strict=True):
                    found[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, pa.list_(pa.float32()))], [*names, "embedding"])

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return rows.withColumn(own, text).mapInArrow(run, schema)


def hash_embed(rows: DataFrame, id_col: str, text_col: str, dimension: int = DIMENSION, prefix: str = "") -> DataFrame:
    """(id, embedding) of each row that has words; see ``with_hash_embedding``."""
    made = with_hash_embedding(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", dimension, prefix)
    return made.where("embedding is not null").select(F.col("id").alias(id_col), "embedding")


def with_hash_embedding(rows: DataFrame, text_col: str = "content", dimension: int = DIMENSION, prefix: str = "") -> DataFrame:
    """``rows`` with a column ``embedding``: counts of a text's lower-case words in ``dimension`` buckets, to unit length.

    The bucket is the first 32 bits of the word's md5. Texts without words, nulls too, have a null. Spark finds
    each word's bucket, and a batch's buckets are counted at once; no row leaves its partition.
    """
    text = F.lower(one_line(F.col(text_col)))
    words = F.regexp_extract_all(with_prefix(text, prefix) if prefix else text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    bucket = F.transform(words, lambda w: (F.conv(F.substring(F.md5(F.encode(w, "UTF-8")), 1, 8), 16, 10).cast("long") % dimension).cast("int"))
    names, (own,) = rows.columns, unused(rows, "buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(own)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(b.num_rows), size) * dimension + lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.bincount(at.astype(np.int64), minlength=b.num_rows * dimension).reshape(b.num_rows, dimension).astype(np.float64)
            counts /= np.sqrt(np.maximum((counts * counts).sum(1, keepdims=True), 1))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * dimension + 1, dimension, dtype=np.int32)), pa.array(counts.ravel()), mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), vectors], [*names, "embedding"])

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return rows.withColumn(own, bucket).mapInArrow(run, schema)
