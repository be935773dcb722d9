"""Collections of chunks in versioned Parquet folders.

A collection's rows lie in buckets by a hash of their key (chunks of one file together), and a state file says
which version of each bucket holds. A change rewrites the buckets it touches into a folder ``<root>/<name>/v=<n>`` and puts
the next state file in place if nobody else has, so that a reader under way keeps what it reads, and a job that dies
leaves the old state in force. Writers need no lock: one that was overtaken moves its change on top of the newer state if
that left its buckets alone, and else does it again from there (see ``commits``). All file work goes through Hadoop's file
system, so a store may be anywhere Spark can write; two writers at once need one that does not rename onto a file that
is there, as HDFS and local disks do.

``Storage`` is what an index needs of a store; another one can be given to it.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import unused
from . import changes, commits
from .commits import Conflict

#: Where no other number is given; large collections take more.
BUCKETS = 32
#: States that stay readable, with what they hold, and how often an overtaken change is done again.
KEEP = 2
RETRIES = 10


class ModelMismatch(ValueError):
    """A collection holds vectors of another model or dimension; ``state`` says which."""

    def __init__(self, name: str, state: dict, dimension: int | None, model_name: str | None):
        super().__init__(f"{name} holds vectors of {state['dimension']} (model {state['model_name']}), not {dimension} (model {model_name})")
        self.state = state


class Storage(Protocol):
    """What an index asks of the place its tables are in."""

    def open(self, name: str, schema, dimension: int | None = None, model_name: str | None = None, key: str = "id") -> dict: ...
    def table(self, name: str) -> DataFrame: ...
    def replace(self, name: str, rows: DataFrame) -> None: ...
    def change_files(self, name: str, files: DataFrame, fresh: DataFrame) -> None: ...
    def delete_collection(self, name: str) -> None: ...
    def count(self, name: str) -> int: ...
    def is_processed(self, name: str) -> bool: ...


class Store:
    """``keep`` states stay readable by their version; a change that was overtaken is done again up to ``retries`` times."""

    def __init__(self, spark: SparkSession, root: str, keep: int = KEEP, retries: int = RETRIES):
        self.spark, self.root, self.keep, self.retries = spark, root.rstrip("/"), max(1, keep), retries

    # -- file system ---------------------------------------------------------------------------------------
    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _states(self, name: str) -> list[str]:
        """State files of a collection, newest first."""
        fs, folder = self._path(name)
        if not fs.exists(folder):
            return []
        return sorted((n for s in fs.listStatus(folder) if commits.is_state(n := s.getPath().getName())), reverse=True)

    def _load(self, name: str, file: str) -> dict:
        fs, path = self._path(name, file)
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _read(self, name: str) -> dict | None:
        for k in range(5):
            known = self._states(name)
            try:
                return self._load(name, known[0]) if known else None
            except Exception:  # gone since it was listed
                if k == 4 or known[0] in self._states(name):
                    raise
        return None

    def _put(self, name: str, state: dict) -> bool:
        """Put a state in place unless there is one of its version."""
        file = commits.state_file(state["version"])
        fs, fresh = self._path(name, f"_{file}.{uuid.uuid4().hex}")
        _, path = self._path(name, file)
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if fs.exists(path):
                return False
            place = fs.resolvePath(fresh).toUri()
            if place.getScheme() != "file":
                return bool(fs.rename(fresh, path))
            return self._link(place.getPath(), file)  # a local rename would replace what is there
        finally:
            fs.delete(fresh, False)

    def _link(self, fresh: str, file: str) -> bool:
        gateway = self.spark.sparkContext._gateway
        files, none = gateway.jvm.java.nio.file, gateway.new_array(gateway.jvm.java.lang.String, 0)
        try:
            files.Files.createLink(files.Path.of(f"{fresh.rsplit('/', 1)[0]}/{file}", none), files.Path.of(fresh, none))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _commit(self, name: str, base: dict, touched: set[str], made: dict[str, object]) -> None:
        """Put the next state in place, on top of what others have committed to other buckets since ``base``."""
        while True:
            newest = self._read(name)
            if newest is None:
                raise Conflict(f"another writer has deleted {name}")
            if self._put(name, commits.proposed(base, newest, touched, made)):
                with contextlib.suppress(Exception):  # another writer may be at it; what is left goes the next time
                    self._forget(name)
                return

    def _forget(self, name: str) -> None:
        """Delete states beyond those that are kept, and folders that only they hold."""
        fs, _ = self._path(name)
        known = self._states(name)
        held = {v for f in known[: self.keep] for v in self._versions(name, f)}
        for f in known[self.keep :]:
            for v in self._versions(name, f) - held:
                fs.delete(self._path(name, f"v={v}")[1], True)
            fs.delete(self._path(name, f)[1], False)

    def _versions(self, name: str, file: str) -> set[str]:
        return {v for held in self._load(name, file)["buckets"].values() for v in commits.folders(held)}

    # -- collections ---------------------------------------------------------------------------------------
    def open(self, name: str, schema, dimension: int | None = None, model_name: str | None = None, key: str = "id", buckets: int = BUCKETS) -> dict:
        """Open a collection or create it. A stored dimension or model that differs is a ``ModelMismatch``, for the
        caller to load the stored model."""
        state = self._read(name)
        if state is None:
            kind = schema if isinstance(schema, T.StructType) else self.spark.createDataFrame([], schema).schema
            state = {"version": 0, "dimension": dimension, "model_name": model_name, "key": key, "n_buckets": buckets, "buckets": {}, "schema": kind.json(), "part": unused(self.spark.createDataFrame([], kind), "bucket")[0]}
            fs, folder = self._path(name)
            fs.mkdirs(folder)
            if not self._put(name, state):  # another writer has just made it
                return self.open(name, schema, dimension, model_name, key, buckets)
        elif any(new is not None and old not in (None, new) for old, new in ((state["dimension"], dimension), (state["model_name"], model_name))):
            raise ModelMismatch(name, state, dimension, model_name)
        return state

    def _opened(self, name: str, version: int | None = None) -> dict:
        state = self._read(name)
        if state is None:
            raise RuntimeError(f"collection {name} is not open")
        if version is None or version == state["version"]:
            return state
        if commits.state_file(version) not in self._states(name):
            raise ValueError(f"version {version} of {name} is not kept")
        return self._load(name, commits.state_file(version))

    def _rows(self, name: str, state: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.root}/{name}/v={v}/{state['part']}={b}" for b, held in state["buckets"].items() if buckets is None or b in buckets for v in commits.folders(held)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A collection's rows now, or as of a version that is kept."""
        return self._rows(name, self._opened(name, version))

    def versions(self, name: str) -> list[int]:
        """The versions that can be read, newest first."""
        return [int(f.removeprefix(commits.STATE).removesuffix(".json")) for f in self._states(name)]

    def model_name(self, name: str) -> str | None:
        return (self._read(name) or {}).get("model_name")

    def _bucket(self, state: dict, key: Column | None = None) -> Column:
        """Bucket of a key; a chunk's is that of its file."""
        owner = F.regexp_replace((F.col(state["key"]) if key is None else key).cast("string"), ":chunk_[0-9]+$", "")
        return F.pmod(F.xxhash64(F.coalesce(owner, F.lit(""))), F.lit(state["n_buckets"])).cast("int")

    def _write(self, name: str, state: dict, rows: DataFrame, touched: list[str]) -> None:
        """Make ``rows`` the content of the touched buckets, as they were in ``state``."""
        version = commits.fresh_folder(state["version"] + 1)
        names, part = [f["name"] for f in json.loads(state["schema"])["fields"]], state["part"]
        fs, path = self._path(name, f"v={version}")
        try:
            # few small files a bucket, and large buckets in several tasks
            rows.select(*names, self._bucket(state).alias(part)).hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(f"{self.root}/{name}/v={version}")
            made = {s.getPath().getName().split("=")[1] for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{part}=")}
            self._commit(name, state, {*touched, *made}, dict.fromkeys(sorted(made), version))
        except BaseException:
            fs.delete(path, True)
            raise

    def _change(self, name: str, make: Callable[[dict], tuple[DataFrame, list[str]]]) -> None:
        """Write what ``make`` says of the present state: (rows, touched buckets); again if another writer was faster."""
        for k in range(self.retries + 1):
            state = self._opened(name)
            try:
                return self._write(name, state, *make(state))
            except Conflict:
                if k == self.retries:
                    raise
            except Exception:
                # what was read may have gone with a state that is no longer kept
                if k == self.retries or commits.state_file(state["version"]) in self._states(name):
                    raise

    def replace(self, name: str, rows: DataFrame) -> None:
        """Make ``rows`` the collection's content; they may come from its present version. If another writer changes the
        collection meanwhile, that is a ``Conflict``."""
        state = self._opened(name)
        self._write(name, state, rows, [str(b) for b in range(state["n_buckets"])])

    def _touched(self, state: dict, keys: DataFrame, key: Column) -> list[str]:
        return [str(r.b) for r in keys.select(self._bucket(state, key).alias("b")).distinct().collect()]  # at most n_buckets

    def add(self, name: str, rows: DataFrame, update: bool = True, order: Column | None = None) -> None:
        """Add rows; known ids are replaced, or with ``update`` off left as they are. Only buckets that get rows
        are read and written. Of new rows with one id the last by ``order`` counts. Vectors of another length than the collection's are an error."""
        state = self._opened(name)
        names = [f["name"] for f in json.loads(state["schema"])["fields"]]
        if state["dimension"] is not None and "embedding" in names:
            size = F.size("embedding")
            rows = rows.withColumn("embedding", F.when(F.col("embedding").isNull() | (size == state["dimension"]), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"{name} holds vectors of {state['dimension']}, not "), size.cast("string")))))
        new = changes.last_of_each(rows, state["key"], order).select(names) if order is not None else rows.select(names)

        def make(state: dict) -> tuple[DataFrame, list[str]]:
            touched = self._touched(state, rows, F.col(state["key"]))
            return (changes.upsert if update else changes.insert_new)(self._rows(name, state, touched), new, state["key"]), touched

        self._change(name, make)

    def delete_ids(self, name: str, ids: DataFrame) -> None:
        def make(state: dict) -> tuple[DataFrame, list[str]]:
            touched = self._touched(state, ids, F.col(state["key"]))
            return changes.delete_keys(self._rows(name, state, touched), ids, state["key"]), touched

        self._change(name, make)

    def change_files(self, name: str, files: DataFrame, fresh: DataFrame) -> None:
        """``fresh`` rows in place of all that ``files`` (file_path) have; only buckets of these files are read and
        written."""

        def make(state: dict) -> tuple[DataFrame, list[str]]:
            names = [f["name"] for f in json.loads(state["schema"])["fields"]]
            touched = self._touched(state, files, F.col("file_path"))
            kept = self._rows(name, state, touched).join(files.select("file_path").distinct(), "file_path", "left_anti")
            return kept.select(names).unionByName(fresh.select(names)), touched

        self._change(name, make)

    def delete_collection(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def count(self, name: str) -> int:
        return self.table(name).count() if self._read(name) else 0

    def is_processed(self, name: str) -> bool:
        return bool(self._read(name)) and not self.table(name).isEmpty()

    def ids(self, name: str) -> DataFrame:
        return self.table(name).select("id").distinct()

    def ids_of_file(self, name: str, file_path: str) -> DataFrame:
        return self.table(name).where(F.col("file_path") == file_path).select("id")
