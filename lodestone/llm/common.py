"""Shared helpers: reading tables, bounded batches, joins of hot keys, and what a Python worker remembers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import unused
from ..sources import scratch
from ..sources.scratch import discard, freeing_shuffles, shared_dir

__all__ = ["discard", "first_half", "freeing_shuffles", "give_up", "held", "hot_from", "materialize", "pieces", "read_table", "shared_dir", "small_batches", "spread_join", "unused"]

#: A key is hot if it has more than one of so many parts of the rows, so there are no more hot keys than that.
HOT_PARTS = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Within it, Python workers get at most so many rows at once: less memory for long texts than Spark's bound
    on the bytes of a batch. The session's setting comes back at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, batch_rows: int = 500) -> DataFrame:
    """Write ``df`` in the shared folder and read it back, so that its lineage ends there; Python workers get
    ``batch_rows`` at once."""
    with small_batches(df.sparkSession, batch_rows):
        return scratch.materialize(df)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that what a task works on at once is small where batches are not. Spark
    bounds a batch's bytes."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has one row a key, although a few keys may hold most of ``big``.

    Rows of hot keys, of which there are at most ``HOT_PARTS`` whatever the size, meet their rows of ``small``
    by a broadcast; all others are shuffled, and none of their keys is large. ``big`` is read several times and
    should be a written table; ``how`` is inner or left. Null keys meet nothing. ``hot`` has the hot keys where
    they are known.
    """
    if hot is None:
        hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_rows")).where(F.col("hot_rows") > hot_from(big.count())).dropna(subset=keys)
    hot = materialize(hot.select(*keys))
    if hot.isEmpty():
        return big.join(small, keys, how)
    few = F.broadcast(materialize(small.join(F.broadcast(hot), keys, "left_semi")))
    held = big.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how)
    rest = big.join(F.broadcast(hot), keys, "left_anti").join(small, keys, how)
    return held.unionByName(rest)


def hot_from(rows: int) -> int:
    """A key with more rows is hot, in a table of so many: at most ``HOT_PARTS`` keys are."""
    return max(1_000, rows // HOT_PARTS)


def first_half(known: dict, most: int) -> dict:
    """``known``, or its older half once it has more than ``most`` entries: frequent words come early."""
    return dict(itertools.islice(known.items(), most // 2)) if len(known) > most else known


_HELD: dict[tuple[str, str], object] = {}


def held(name: str, path: str, load):
    """What ``load(path)`` makes, kept in this Python worker for its next tasks until another kind is asked for.

    Workers are reused from stage to stage, and what one operator remembers must not stand beside what the
    next one needs.
    """
    key = (name, path)
    if key not in _HELD:
        give_up()
        _HELD[key] = load(path)
    return _HELD[key]


def give_up() -> None:
    """Let go of whatever earlier tasks left in this worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
