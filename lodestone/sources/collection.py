"""Collections of a store as a data source of Spark.

    register(spark)
    spark.read.format("lodestone").load("/data/store/chunks").where("file_path = 'src/a.py'")
    rows.write.format("lodestone").mode("append").save("/data/store/chunks")

Reading takes the newest state, or that of the option ``version``; filters on the key or the file say which buckets are read, a
task each file. Writing puts files beside the collection's and commits them as one state: ``append`` adds rows, whose ids must
be new (``Store.add`` is what replaces known ones), ``overwrite`` replaces all there are. A job that fails leaves the old state.

Tasks read and write by pyarrow's file systems, so the path must be one that these reach (local and shared folders, HDFS, S3,
GCS). A state is put in place by a link on a local disk; elsewhere by a check and a rename, which two writers can both pass.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import commits

_CHUNK = re.compile(r":chunk_[0-9]+$")
#: Rows of a batch that is read.
ROWS = 4_096


def bucket_of(key: str | None, n_buckets: int) -> int:
    """The bucket that Spark's hash gives a key; a chunk's is that of its file."""
    h = xxhash.xxh64_intdigest(_CHUNK.sub("", key or "").encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % n_buckets


class _Collection:
    """The files of one collection."""

    def __init__(self, path: str):
        self.uri = path if "://" in path or path.startswith("file:") else os.path.abspath(path)
        if self.uri.startswith("file:/") and not self.uri.startswith("file://"):
            self.uri = "file://" + self.uri.removeprefix("file:")

    def open(self) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        return fs, root.rstrip("/")

    def state(self, version: int | None = None) -> dict:
        fs, root = self.open()
        known = sorted((f.base_name for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if commits.is_state(f.base_name)), reverse=True)
        if not known:
            raise RuntimeError(f"there is no collection in {self.uri}")
        file = known[0] if version is None else commits.state_file(version)
        if file not in known:
            raise ValueError(f"version {version} of {self.uri} is not kept")
        with fs.open_input_stream(f"{root}/{file}") as f:
            return json.loads(f.read())

    def put(self, state: dict) -> bool:
        fs, root = self.open()
        file = f"{root}/{commits.state_file(state['version'])}"
        fresh = f"{root}/_{commits.state_file(state['version'])}.{uuid.uuid4().hex}"
        with fs.open_output_stream(fresh) as f:
            f.write(json.dumps(state).encode())
        if isinstance(fs, pafs.LocalFileSystem):
            try:
                os.link(fresh, file)
            except FileExistsError:
                return False
            finally:
                os.unlink(fresh)
            return True
        if fs.get_file_info(file).type != pafs.FileType.NotFound:
            fs.delete_file(fresh)
            return False
        fs.move(fresh, file)
        return True


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone"

    def _at(self) -> tuple[_Collection, dict]:
        if "path" not in self.options:
            raise ValueError("the path of a collection is missing")
        version = self.options.get("version")
        collection = _Collection(self.options["path"])
        return collection, collection.state(int(version) if version is not None else None)

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._at()[1]["schema"]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CollectionReader(*self._at(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        collection, state = self._at()
        own = T.StructType.fromJson(json.loads(state["schema"]))
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in own]:
            raise ValueError(f"{collection.uri} has {own.simpleString()}, not {schema.simpleString()}")
        return CollectionWriter(collection, state, schema, overwrite)


@dataclass
class _File(InputPartition):
    path: str


class CollectionReader(DataSourceReader):
    def __init__(self, collection: _Collection, state: dict, schema: T.StructType):
        self.collection, self.state, self.schema, self.buckets = collection, state, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the key or the file say which buckets are read; Spark applies them all the same."""
        for f in filters:
            owner = getattr(f, "attribute", None) in (("file_path",), (self.state["key"],))
            if owner and isinstance(f, EqualTo | EqualNullSafe | In):
                values = f.value if isinstance(f, In) else [f.value]
                if all(v is None or isinstance(v, str) for v in values):
                    own = {str(bucket_of(v, self.state["n_buckets"])) for v in values}
                    self.buckets = own if self.buckets is None else self.buckets & own
        return filters

    def partitions(self) -> list[InputPartition]:
        fs, root = self.collection.open()
        out = []
        for bucket, held in self.state["buckets"].items():
            if self.buckets is None or bucket in self.buckets:
                for v in commits.folders(held):
                    folder = pafs.FileSelector(f"{root}/v={v}/{self.state['part']}={bucket}")
                    out += [_File(f.path) for f in fs.get_file_info(folder) if f.path.endswith(".parquet")]
        return sorted(out, key=lambda f: f.path)

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = self.collection.open()
        kinds = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(ROWS, columns=kinds.names):
                yield pa.RecordBatch.from_arrays([b.column(x.name).cast(x.type) for x in kinds], kinds.names)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (bucket, path)


class CollectionWriter(DataSourceArrowWriter):
    """Tasks write where nobody reads; the commit moves what the tasks that counted have written, and puts the state in place."""

    def __init__(self, collection: _Collection, state: dict, schema: T.StructType, overwrite: bool):
        self.collection, self.state, self.schema, self.overwrite = collection, state, schema, overwrite
        self.folder = commits.fresh_folder(state["version"] + 1)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = self.collection.open()
        own, state = f"{root}/v={self.folder}/_{uuid.uuid4().hex}", self.state
        fs.create_dir(own, recursive=True)
        writers: dict[int, pq.ParquetWriter] = {}
        with contextlib.ExitStack() as stack:
            for b in iterator:
                if state["dimension"] is not None and "embedding" in b.schema.names:
                    odd = set(pc.list_value_length(b.column("embedding")).to_pylist()) - {None, state["dimension"]}
                    if odd:
                        raise ValueError(f"{self.collection.uri} holds vectors of {state['dimension']}, not {odd.pop()}")
                at: dict[int, list[int]] = {}
                for i, key in enumerate(b.column(state["key"]).cast(pa.string()).to_pylist()):
                    at.setdefault(bucket_of(key, state["n_buckets"]), []).append(i)
                for bucket, rows in at.items():
                    if bucket not in writers:
                        writers[bucket] = stack.enter_context(pq.ParquetWriter(f"{own}/{bucket}.parquet", b.schema, filesystem=fs))
                    writers[bucket].write_batch(b.take(pa.array(rows)))
        return _Written([(str(bucket), f"{own}/{bucket}.parquet") for bucket in writers])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self.collection.open()
        base = f"{root}/v={self.folder}"
        made = set()
        for bucket, path in (f for m in messages if m is not None for f in m.files):
            folder = f"{base}/{self.state['part']}={bucket}"
            if bucket not in made:
                fs.create_dir(folder, recursive=True)
                made.add(bucket)
            fs.move(path, f"{folder}/part-{uuid.uuid4().hex}.parquet")
        for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if f.base_name.startswith("_"):
                fs.delete_dir(f.path)
        touched = {str(b) for b in range(self.state["n_buckets"])} if self.overwrite else set()
        while not self.collection.put(commits.proposed(self.state, self.collection.state(), touched, dict.fromkeys(sorted(made, key=int), self.folder), added=not self.overwrite)):
            pass  # another writer was faster: once more on top of its state

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self.collection.open()
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(f"{root}/v={self.folder}")


def register(spark: SparkSession) -> None:
    """Make the format known in a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectionSource)
