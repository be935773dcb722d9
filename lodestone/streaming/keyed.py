"""State for each key of a stream: clients that stop calling, and files that come, change and go.

Both keep what they know in the state store, with event-time timers for what is told by silence. They need
the RocksDB state store: start their streams within ``keyed_state(spark)``, which sets it and puts the setting back.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Files are kept in so many groups by a hash of their path; a group's state is read and written as a whole.
GROUPS = 64
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Clients(StatefulProcessor):
    def __init__(self, seconds: int):
        self.timeout = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at bigint")

    def _told(self, client, at: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"client": pd.Series([client] * len(at), dtype=object), "last_seen": pd.Series(at, dtype="int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = sorted(at for part in rows for at in part["at"].tolist())
        known = self.last.get()[0] if self.last.exists() else None
        if known is not None:
            calls = [known, *(at for at in calls if at > known)] if calls[-1] > known else [known]
        gone = [a for a, b in zip(calls, calls[1:], strict=False) if b - a > self.timeout]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((calls[-1],))
        self.handle.registerTimer((calls[-1] + self.timeout) // 1000 + 1)
        yield self._told(key[0], gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0]
        self.last.clear()
        yield self._told(key[0], [at])

    def close(self) -> None:
        pass


def expiries(calls: DataFrame, seconds: int = 120, late: str = "0 seconds") -> DataFrame:
    """(client, last_seen) each time a client has made no call for longer than ``seconds``; times in microseconds.

    ``calls`` is a stream of (client, ts). A client's state is its last call and a timer, and goes when the timer fires: once
    calls of others are that much later, less ``late``, which calls may come out of order. Silences count to the millisecond.
    Rows without a client or time are left out. What is told does not depend on how calls are cut into batches.
    """
    client = calls.schema["client"].dataType.simpleString()
    seen = calls.select("client", F.col("ts").cast("timestamp").alias("ts")).where("client IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return seen.groupBy("client").transformWithStateInPandas(_Clients(seconds), f"client {client}, last_seen long", "Append", "EventTime")


def file_status(known: tuple | None, mtime: float | None, size: int | None, content_hash: str | None, verify_with_hash: bool = True) -> str:
    """As ``detect_changes`` judges a file that is listed; ``known`` is (mtime, size, content_hash) or None."""
    if known is None:
        return "added"
    if mtime is None or size is None:
        return "deleted"
    if (mtime, size) == known[:2]:
        return "unchanged"
    return "modified" if not verify_with_hash or content_hash is not None and content_hash != known[2] else "unchanged"


def _told(rows: list[tuple[int, str, str]]) -> pd.DataFrame:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pd.DataFrame({n: pd.Series(list(c), dtype=t) for n, c, t in zip(("at", "file_path", "status"), columns, ("int64", object, object), strict=True)})


class _Files(StatefulProcessor):
    def __init__(self, verify_with_hash: bool):
        self.verify = verify_with_hash

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("files", "paths array<string>, mtimes array<double>, sizes array<bigint>, hashes array<string>, seen array<bigint>")

    def _known(self) -> dict[str, tuple]:
        if not self.state.exists():
            return {}
        paths, *rest = self.state.get()
        return dict(zip(paths, zip(*rest, strict=True), strict=True))

    def _keep(self, files: dict[str, tuple]) -> None:
        if files:
            columns = list(zip(*files.values(), strict=True))
            self.state.update((list(files), *map(list, columns)))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        files, told = self._known(), []
        listed, through = pd.concat(list(rows)).sort_values("at", kind="stable"), timerValues.getCurrentWatermarkInMs() * 1000
        plain = listed[["mtime", "size", "content_hash"]].astype(object).where(listed[["mtime", "size", "content_hash"]].notna(), None)
        for path, at, mtime, size, digest in zip(listed["file_path"], listed["at"].tolist(), plain["mtime"], plain["size"], plain["content_hash"], strict=True):
            own = files.get(path)
            if own is not None and own[3] >= at:
                continue  # told before
            if own is not None and own[3] < through < at:  # its timer is due: a listing between lacked it
                told.append((own[3] // 1000 * 1000 + 1000, path, "deleted"))
                own = None
            size = None if size is None else int(size)
            status = file_status(own[:3] if own else None, mtime, size, digest, self.verify)
            told.append((at, path, status))
            if status == "deleted":
                del files[path]
            else:
                stands = own is not None and status == "unchanged" and (mtime, size) == own[:2]
                files[path] = (mtime, size, own[2] if stands else digest, at)
        self._keep(files)
        last = int(listed["at"].max())
        self.handle.registerTimer(last // 1000 + 1)
        yield _told(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A later listing is through: what was last in this one or before is gone."""
        until, files = expiredTimerInfo.getExpiryTimeInMs() * 1000, self._known()
        gone = [p for p, f in files.items() if f[3] < until]
        self._keep({p: f for p, f in files.items() if f[3] >= until})
        yield _told([(until, p, "deleted") for p in gone])

    def close(self) -> None:
        pass


def file_changes(listings: DataFrame, verify_with_hash: bool = True, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """(at, file_path, status) from a stream of whole listings (ts, file_path, mtime, size, content_hash); ``at`` in microseconds.

    All rows of one listing have its ``ts``. Each listed file is judged against what was known of it as ``detect_changes``
    does; a file that a listing lacks is told as deleted (``at`` is just after it was last listed) once a later listing is through,
    which is when a batch has had its rows, and what may be ``late`` of it. So each listing should come in a batch of its own:
    of several in one batch only the last says what is gone. What is known of a file is its time, size and hash, in the state store. A file listed without
    time or size is deleted; rows without a path or ``ts`` are left out, and of several of one file and listing the first counts.
    """
    rows = listings.select("file_path", F.col("ts").cast("timestamp").alias("ts"), F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"), "content_hash")
    rows = rows.where("file_path IS NOT NULL AND ts IS NOT NULL").withColumns({"part": F.pmod(F.xxhash64("file_path"), F.lit(groups)), "at": F.unix_micros("ts")}).withWatermark("ts", late)
    return rows.groupBy("part").transformWithStateInPandas(_Files(verify_with_hash), "at long, file_path string, status string", "Append", "EventTime")


def replay(made: DataFrame, into: str, checkpoint: str) -> DataFrame:
    """Run a stream of one of these to the end of what is there, and read what it told."""
    spark = made.sparkSession
    with keyed_state(spark):
        made.writeStream.format("parquet").outputMode("append").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(into)
