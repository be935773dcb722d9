"""Source trees as DataFrames.

Spark's own file sources pass over names that begin with a dot or an underscore, which source trees are full of,
so folders are walked, and files read, inside tasks through Arrow's file systems.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import filters

#: Folders that are enough to share out the walk, and the levels that the driver lists at most to find them.
WALKS, DRIVER_LEVELS = 64, 3


def _open(root: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        found, path = arrow_fs.FileSystem.from_uri(root)
        return found, path.rstrip("/")
    return arrow_fs.LocalFileSystem(), root.rstrip("/")


def _listed(system: arrow_fs.FileSystem, folder: str) -> list[arrow_fs.FileInfo]:
    return system.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))


def is_folder(root: str) -> bool:
    system, base = _open(root)
    return system.get_file_info(base).type == arrow_fs.FileType.Directory


def _pruned(name: str, patterns) -> bool:
    return any(fnmatch.fnmatchcase(name, p) for p in patterns)


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where valid, else Latin-1; all line ends become newlines."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def gitignore_lines(root: str) -> list[str]:
    """Lines of ``<root>/.gitignore``; none if there is no such file."""
    system, base = _open(root)
    path = f"{base}/.gitignore"
    if system.get_file_info(path).type != arrow_fs.FileType.File:
        return []
    with system.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace").splitlines()


def list_files(spark: SparkSession, root: str, prune=tuple(filters.IGNORED)) -> DataFrame:
    """(file_path, rel_path, mtime, size) of all files below ``root``.

    The driver lists the root, and a few levels more until there are ``WALKS`` folders; each of these is walked
    in a task. Folders whose name matches a pattern of ``prune`` are not entered.
    """
    system, base = _open(root)
    skip, files, folders = len(base) + 1, [], [base]
    for _ in range(DRIVER_LEVELS):
        entries = [e for f in folders for e in _listed(system, f) if not _pruned(e.base_name, prune)]
        files += [(e.path, e.path[skip:], e.mtime_ns / 1e9, e.size) for e in entries if e.type == arrow_fs.FileType.File]
        folders = [e.path for e in entries if e.type == arrow_fs.FileType.Directory]
        if len(folders) >= WALKS:
            break
    schema = "file_path string, rel_path string, mtime double, size long"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, _ = _open(root)
        for b in batches:
            todo = b.column(0).to_pylist()
            while todo:
                some = [e for e in _listed(inside, todo.pop()) if not _pruned(e.base_name, prune)]
                todo += [e.path for e in some if e.type == arrow_fs.FileType.Directory]
                found = [e for e in some if e.type == arrow_fs.FileType.File]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e.path for e in found], pa.string()), pa.array([e.path[skip:] for e in found], pa.string()),
                     pa.array([e.mtime_ns / 1e9 for e in found], pa.float64()), pa.array([e.size for e in found], pa.int64())], ["file_path", "rel_path", "mtime", "size"])

    here = spark.createDataFrame(files, schema)
    if not folders:
        return here
    parts = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders))
    return here.unionByName(parts.mapInArrow(walk, schema))


def discover_files(spark: SparkSession, root: str, exclude_tests: bool = False, additional_ignored=(), ordered: bool = True) -> DataFrame:
    """(file_path, rel_path, mtime, size) of the source files below ``root``, by path unless ``ordered`` is off;
    nothing is read yet."""
    files = list_files(spark, root)
    kept = ~filters.ignored(F.col("rel_path"), gitignore_lines(root), additional_ignored) & filters.is_source_file(F.col("rel_path"))
    if exclude_tests:
        kept &= ~filters.is_test_file(F.col("file_path"))
    return files.where(kept).orderBy("file_path") if ordered else files.where(kept)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``files`` with their bytes as ``content``; null where a file cannot be read."""
    names = files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(root)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                some, found = b.slice(k, 64), []
                for path in some.column("file_path").to_pylist():
                    try:
                        with system.open_input_stream(path) as f:
                            found.append(f.read())
                    except OSError:
                        found.append(None)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.binary())], [*names, "content"])

    return files.mapInArrow(read, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def with_hash(files: DataFrame) -> DataFrame:
    """Add the SHA-256 of the bytes."""
    return files.withColumn("content_hash", F.sha2("content", 256))


def looks_like_codebase(spark: SparkSession, root: str, least: int = 5) -> bool:
    """Whether the folder has a marker at its root, or at least ``least`` source files."""
    system, base = _open(root)
    if {e.base_name for e in _listed(system, base)} & set(filters.CODEBASE_MARKERS):
        return True
    return discover_files(spark, root, ordered=False).limit(least).count() >= least
