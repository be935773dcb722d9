"""Building an index of a source tree, and keeping it up to date."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import changes, chunking, embedding
from ..operators.store import ModelMismatch, Storage, Store
from ..sources import files

CHUNKS = "chunks"
METADATA = "files"


def collection_of(root: str) -> str:
    return "codebase_" + hashlib.sha256(str(Path(root).resolve()).encode()).hexdigest()[:16]


class Index:
    """The chunks and file metadata of one tree in a store.

    ``embed`` adds the column ``embedding``, of ``dimension`` numbers, to chunks; without it words are hashed. If the
    stored vectors are of another model or dimension, ``load`` gets the stored model's name and returns the ``embed``
    to go on with; without it that is an error. ``force`` drops what is stored first. ``progress`` is called
    with the name of a step and its counts once the step is done. ``storage`` makes the store from its root.
    """

    def __init__(self, spark: SparkSession, store_root: str, root: str, embed: Callable[[DataFrame], DataFrame] | None = None,
                 chunk_size: int = chunking.CHUNK_SIZE, exclude_tests: bool = False, additional_ignored=(), model_name: str = "hash", dimension: int | None = None,
                 load: Callable[[str], Callable[[DataFrame], DataFrame]] | None = None, force: bool = False, progress: Callable[[str, dict], None] | None = None,
                 storage: Callable[[SparkSession, str], Storage] = Store):
        if not files.is_folder(root):
            raise ValueError(f"{root} is not a folder")
        self.spark, self.root = spark, root
        self.store = storage(spark, f"{store_root.rstrip('/')}/{collection_of(root)}")
        self.embed, self.model_name, self.progress = embed or embedding.with_hash_embedding, model_name, progress
        dimension = embedding.DIMENSION if embed is None else dimension
        self.chunk_size, self.exclude_tests, self.additional_ignored = chunk_size, exclude_tests, tuple(additional_ignored)
        self.chunk_schema = T.StructType([*schemas.CHUNKS.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
        if force:
            self.store.delete_collection(CHUNKS)
            self.store.delete_collection(METADATA)
        try:
            self.store.open(CHUNKS, self.chunk_schema, dimension=dimension, model_name=model_name)
        except ModelMismatch as e:
            if load is None:
                raise
            self.model_name = e.state["model_name"]
            self.embed = load(self.model_name)
        self.store.open(METADATA, schemas.FILES, key="file_path")

    def listed(self) -> DataFrame:
        return files.discover_files(self.spark, self.root, self.exclude_tests, self.additional_ignored, ordered=False)

    def _read(self, found: DataFrame) -> DataFrame:
        return files.with_hash(files.with_content(found, self.root)).select("file_path", "mtime", "size", "content_hash", files.decoded(F.col("content")).alias("content"))

    def _chunked(self, rows: DataFrame) -> tuple[DataFrame, Observation]:
        chunks = self.embed(chunking.chunk_files(rows, self.chunk_size)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.chunk_schema])
        seen = Observation()
        return chunks.observe(seen, F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("characters")), seen

    def _metadata(self, rows: DataFrame, now: float) -> DataFrame:
        counts = self.store.table(CHUNKS).groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        return (rows.drop("content").join(counts, "file_path", "left")
                .select("file_path", "mtime", "size", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "content_hash", F.lit(now).alias("last_indexed")))

    def _tell(self, step: str, counts: dict) -> None:
        if self.progress:
            self.progress(step, counts)

    def build(self, now: float | None = None) -> int:
        """Index the whole tree anew; how many chunks there are. Without source files nothing changes."""
        now, found = time.time() if now is None else now, self.listed()
        n = found.count()
        if n == 0:
            return 0
        self._tell("listed", {"files": n})
        rows = self._read(found)
        chunks, seen = self._chunked(rows)
        self.store.replace(CHUNKS, chunks)
        self._tell("chunked", seen.get)
        self.store.replace(METADATA, self._metadata(rows, now))
        self._tell("stored", {"files": n})
        return self.store.count(CHUNKS)

    def update(self, now: float | None = None, verify_with_hash: bool = True) -> dict[str, int]:
        """Bring the index to the state of the tree; how many files were added, modified, deleted, unchanged.

        The listing is compared first; only files that are new, or of another time or size, are read.
        """
        now = time.time() if now is None else now
        known = self.store.table(METADATA)
        listed = self.listed().withColumn("content_hash", F.lit(None).cast("string")).persist()
        first = changes.detect_changes(known, listed, verify_with_hash=False).persist()
        try:
            again = first.where(F.col("status").isin("added", "modified")).select("file_path")
            rows = self._read(listed.drop("content_hash").join(again, "file_path", "left_semi")).persist()
            judged = changes.detect_changes(known.join(again, "file_path", "left_semi"), rows, verify_with_hash)
            diff = first.where(~F.col("status").isin("added", "modified")).unionByName(judged).persist()
            summary = {r.status: r.files for r in changes.change_summary(diff).collect()}
            self._tell("compared", summary)
            if set(summary) - {"unchanged"}:
                changed = diff.where("status != 'unchanged'").select("file_path")
                fresh = rows.join(diff.where(F.col("status").isin("added", "modified")).select("file_path"), "file_path", "left_semi")
                chunks, seen = self._chunked(fresh)
                self.store.change_files(CHUNKS, changed, chunks)
                self._tell("chunked", seen.get)
                self.store.change_files(METADATA, changed, self._metadata(fresh, now))
            diff.unpersist()
            rows.unpersist()
        finally:
            first.unpersist()
            listed.unpersist()
        return {s: summary.get(s, 0) for s in ("added", "modified", "deleted", "unchanged")}

    def ensure(self, debounce_minutes: int = 10, now: float | None = None, verify_with_hash: bool = True, validate: Callable[[str], bool] | None = None) -> dict:
        """Build if there is nothing yet; update if the last time is long enough ago; else leave it. A folder that
        does not look like a codebase is built only if ``validate`` says so."""
        now = time.time() if now is None else now
        if not self.store.is_processed(CHUNKS):
            if not files.looks_like_codebase(self.spark, self.root) and not (validate and validate(self.root)):
                return {"status": "not_a_codebase"}
            return {"status": "indexed", "chunks": self.build(now)}
        last = self.store.table(METADATA).agg(F.max("last_indexed")).head()[0]
        if last and now - last < debounce_minutes * 60:
            return {"status": "recent"}
        return {"status": "updated", **self.update(now, verify_with_hash)}
