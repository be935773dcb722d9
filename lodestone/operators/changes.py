"""What changed between two states of a tree, and the tables that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import unused


def detect_changes(tracked: DataFrame, current: DataFrame, verify_with_hash: bool = True) -> DataFrame:
    """(file_path, status) from (file_path, mtime, size, content_hash) tables of then and now.

    Not tracked: added. Gone, or without size or time: deleted. Equal time and size: unchanged. Otherwise, with
    hashes, modified only if there is a hash now that differs from the stored one (a missing stored one
    differs); without, modified.
    """
    t = tracked.select("file_path", *[F.col(c).alias(f"old_{c}") for c in ("mtime", "size", "content_hash")], F.lit(True).alias("was"))
    c = current.select("file_path", "mtime", "size", "content_hash", F.lit(True).alias("is"))
    differs = F.col("content_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("old_content_hash")) if verify_with_hash else F.lit(True)
    status = (F.when(F.col("was").isNull(), "added")
              .when(F.col("is").isNull() | F.col("mtime").isNull() | F.col("size").isNull(), "deleted")
              .when((F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")), "unchanged")
              .when(differs, "modified").otherwise("unchanged"))
    return t.join(c, "file_path", "full").select("file_path", status.alias("status"))


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def delete_of_files(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """The chunks of files that are neither deleted nor modified."""
    stale = changes.where(F.col("status").isin("deleted", "modified")).select("file_path")
    return chunks.join(stale, "file_path", "left_anti")


def should_reindex(last: Column, now: Column, minutes: int = 10) -> Column:
    """Whether so many minutes have gone by since ``last`` (seconds), or nothing was indexed yet."""
    return F.when(last.isNull() | (last == 0), True).otherwise((now - last) >= minutes * 60)


def last_of_each(rows: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """One row a key: the last by ``order``, which rows of a key should differ in; without it, or among equal ones,
    that of the largest hash, so that a task run again keeps the same."""
    (rank,) = unused(rows, "rank")
    by = [F.desc_nulls_last(order)] if order is not None else []
    w = Window.partitionBy(key).orderBy(*by, F.desc(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in rows.columns])))
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """``new`` rows replace those of the same key. Of several new ones ``last_of_each`` counts."""
    return old.join(new.select(key), key, "left_anti").unionByName(last_of_each(new, key, order))


def insert_new(old: DataFrame, new: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """``new`` rows with a known key are left out. Of several with one key ``last_of_each`` counts."""
    return old.unionByName(last_of_each(new.join(old.select(key), key, "left_anti"), key, order))


def delete_keys(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")
