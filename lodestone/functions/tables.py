"""Table functions for SQL: chunks and definitions of a text, called with LATERAL.

``register(spark)`` makes them known in a session:

    SELECT f.file_path, c.* FROM files f, LATERAL line_chunks(f.content, 1024) c
    SELECT f.file_path, c.* FROM files f, LATERAL syntax_chunks(f.content, f.file_path) c
    SELECT f.file_path, n.* FROM files f, LATERAL syntax_nodes(f.content, f.file_path) n

Each checks its arguments when the query is planned. A null or empty text has no rows; a null size is the usual one, and a
null path that of a file in no known language.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .. import schemas
from ..operators import chunking

_LINES = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("chunk_index", "total_chunks", "start_char", "end_char", "start_line", "end_line")], T.StructField("content", T.StringType())])
_CHUNKS = T.StructType([T.StructField(f.name, f.dataType) for f in schemas.CHUNKS if f.name != "file_path"])
_NODES = T.StructType([T.StructField(n, T.IntegerType() if t == "int" else T.StringType()) for n, t in (c.split() for c in chunking.NODES.split(", "))])


def _strings(name: str, arguments: dict[str, AnalyzeArgument]) -> None:
    for what, a in arguments.items():
        if a.isTable or not isinstance(a.dataType, T.StringType | T.NullType):
            raise ValueError(f"{name}: {what} must be a string, not {'a table' if a.isTable else a.dataType.simpleString()}")


def _size(name: str, size: AnalyzeArgument | None) -> None:
    if size is not None and not isinstance(size.dataType, T.IntegralType | T.NullType):
        raise ValueError(f"{name}: size must be a whole number, not {size.dataType.simpleString()}")


class LineChunks:
    """Chunks of at most ``size`` characters that end at lines where they can."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        _strings("line_chunks", {"text": text})
        _size("line_chunks", size)
        return AnalyzeResult(_LINES)

    def eval(self, text: str | None, size: int | None = None) -> Iterator[tuple]:
        text, line = text or "", 1
        cuts = chunking.line_cuts(text, chunking.CHUNK_SIZE if size is None else size)
        for k, (s, e) in enumerate(cuts):
            last = line + text.count("\n", s, e)
            yield k, len(cuts), s, e, line, last, text[s:e]
            line = last


class SyntaxChunks:
    """Chunks that end where definitions and statements do, with their symbols."""

    @staticmethod
    def analyze(text: AnalyzeArgument, path: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        _strings("syntax_chunks", {"text": text, "path": path})
        _size("syntax_chunks", size)
        return AnalyzeResult(_CHUNKS)

    def eval(self, text: str | None, path: str | None, size: int | None = None) -> Iterator[tuple]:
        for row in chunking.chunk_file(text or "", path or "", chunking.CHUNK_SIZE if size is None else size):
            yield tuple(row[f.name] for f in _CHUNKS)


class SyntaxNodes:
    """Functions and classes, with the ones they stand in."""

    @staticmethod
    def analyze(text: AnalyzeArgument, path: AnalyzeArgument) -> AnalyzeResult:
        _strings("syntax_nodes", {"text": text, "path": path})
        return AnalyzeResult(_NODES)

    def eval(self, text: str | None, path: str | None) -> Iterator[tuple]:
        yield from chunking.nodes_of(text or "", path or "")


TABLE_FUNCTIONS = {"line_chunks": LineChunks, "syntax_chunks": SyntaxChunks, "syntax_nodes": SyntaxNodes}


def register(spark: SparkSession) -> None:
    for name, made in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(made, useArrow=True))
