"""Structured Streaming: an index that follows its tree, and clients that stop calling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes


def follow_files(spark: SparkSession, root: str, checkpoint: str, update: Callable[[], object], once: bool = True):
    """Call ``update`` whenever new files came below ``root``.

    A file stream only tells of new files, so every trigger compares whole listings (``update``), which also
    finds what was changed or deleted.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root).select("path")

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            update()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def upsert_stream(stream: DataFrame, store, name: str, checkpoint: str, order: str | None = None):
    """Upsert every batch of a stream of chunks into a collection; of one id the last by the column ``order`` counts."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.add(name, batch, order=F.col(order) if order else None)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def active_windows(events: DataFrame, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """(client, start, end, calls) of each client's runs of calls, ended by ``gap`` without one."""
    return (events.withWatermark("ts", late).groupBy("client", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("calls")).select("client", "s.start", "s.end", "calls"))


def expired_clients(calls: DataFrame, now: Column, seconds: int = 120) -> DataFrame:
    """(client, last_seen, expired) from ``calls`` (client, at), times in microseconds."""
    last = calls.groupBy("client").agg(F.max("at").alias("last_seen"))
    return last.withColumn("expired", now - F.col("last_seen") > seconds * 1_000_000)


def debounced(times: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """(client, last, due) from ``times`` (client, at), in microseconds: whether the last is long enough ago."""
    last = times.groupBy("client").agg(F.max("at").alias("last"))
    return last.withColumn("due", changes.should_reindex(F.col("last") / 1_000_000, now / 1_000_000, minutes))
