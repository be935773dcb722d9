"""Chunks of files: by lines, or on syntax boundaries, with positions and neighbours.

Where a cut falls depends on the cut before it, so a text is walked once in an Arrow-batched function; all that
relates chunks to one another is windows and joins.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import unused
from ..functions.text import chunk_id
from . import syntax

CHUNK_SIZE = 1024

# The language of each suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java",
    ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".h": "c", ".rb": "ruby", ".php": "php", ".cs": "c_sharp",
}
_HEADER = re.compile(r"(?:import|from|package|use|extern crate|export|#include|#define|typedef)\b|(?:#include|#define)")


def line_cuts(text: str, size: int = CHUNK_SIZE) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``size`` characters that tile the text; a size below one counts as one.

    A chunk ends after the last newline of its second half, if there is one.
    """
    size = max(1, size or 1)
    cuts, at, n = [], 0, len(text)
    while n - at > size:
        end = at + size
        line = text.rfind("\n", at + size // 2, end)
        end = line + 1 if line >= 0 else end
        cuts.append((at, end))
        at = end
    if n > at:
        cuts.append((at, n))
    return cuts


def chunk_lines(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """``docs`` (file_path, content) as (file_path, chunk_index, total_chunks, start_char, end_char, start_line,
    end_line, content). An empty or null text has no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cuts, line = line_cuts(text or "", size), 1
                for k, (s, e) in enumerate(cuts):
                    last = line + text.count("\n", s, e)
                    rows.append((path, k, len(cuts), s, e, line, last, text[s:e]))
                    line = last
            yield _batch(rows, _LINE_FIELDS)

    return docs.select("file_path", "content").mapInArrow(run, "file_path string, chunk_index int, total_chunks int, start_char int, end_char int, start_line int, end_line int, content string")


_LINE_FIELDS = [("file_path", pa.string()), *[(c, pa.int32()) for c in ("chunk_index", "total_chunks", "start_char", "end_char", "start_line", "end_line")], ("content", pa.string())]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """Add the chunk's id and its neighbours' numbers, -1 at the ends."""
    i = F.col("chunk_index")
    return chunks.withColumns({
        "id": chunk_id(F.col("file_path"), i),
        "prev_id": F.when(i > 0, i - 1).otherwise(-1),
        "next_id": F.when(i < F.col("total_chunks") - 1, i + 1).otherwise(-1),
    })


def definitions(text: str, language: str) -> list[tuple[int, int, int, str, str]]:
    """(start, end of the signature, end, name, kind) of functions and classes in order of appearance; kind is
    function or class."""
    if language == "python":
        return _python_definitions(text)
    return [(n.start, n.head, n.end, n.name, n.kind) for n in syntax.scan(text, language).nodes] if language in syntax.LANGUAGES else []


def _line_starts(text: str) -> list[int]:
    """Where lines begin, as Python's parser counts them, and the end of the text."""
    return [0, *(m.end() for m in re.finditer("\r\n|\r|\n", text)), len(text)]


def _first_line(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])


def _python_definitions(text: str) -> list[tuple[int, int, int, str, str]]:
    """The signature goes up to the body, and has the docstring if there is one."""
    starts, found = _line_starts(text), []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = node.body[0]
            doc = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
            body = first.end_lineno if doc else max(_first_line(first) - 1, node.lineno)
            found.append((starts[_first_line(node) - 1], starts[body], starts[node.end_lineno], node.name, "class" if isinstance(node, ast.ClassDef) else "function"))
    return sorted(found)


def _python_marks(text: str, size: int) -> set[int]:
    """Starts and ends of statements; those within a statement only where it is longer than ``size``."""
    starts, marks, todo = _line_starts(text), set(), list(ast.parse(text).body)
    while todo:
        node = todo.pop()
        s, e = starts[_first_line(node) - 1], starts[node.end_lineno]
        marks |= {s, e}
        if e - s > size:
            inner = [x for field in ("body", "orelse", "finalbody", "handlers", "cases") for x in getattr(node, field, ())]
            todo += [x for x in inner if isinstance(x, ast.stmt)]
            todo += [x for block in inner if not isinstance(block, ast.stmt) for x in block.body]
    return marks


def _brace_marks(text: str, language: str, size: int) -> set[int]:
    """Ends of statements and blocks, those within a block only where it is longer than ``size``."""
    found = syntax.scan(text, language)
    short: list[tuple[int, int]] = []  # blocks that stay whole
    for s, e in sorted(found.blocks):
        if e - s <= size and not (short and e <= short[-1][1]):
            short.append((s, e))
    marks, k = set(), 0
    for e in sorted(e for _, e in found.blocks + found.stops):
        while k < len(short) and short[k][1] < e:
            k += 1
        if k == len(short) or not short[k][0] < e < short[k][1]:
            marks.add(e + 1 if text[e : e + 1] == "\n" else e)
    return marks


#: What stands round the signature that a continuation repeats, and the least room for the rest.
CONTINUED = "# [continued from above]\n{}\n    # ...\n"
LEAST_ROOM = 200
#: Lines of a signature that are repeated at most.
SIGNATURE_LINES = 21


def signature_of(text: str, found: list[tuple[int, int, int, str, str]], at: int, size: int) -> str:
    """The signature of the innermost definition that goes on at ``at``; empty if there is none, or no room for it."""
    inside = [d for d in found if d[1] <= at < d[2] and d[0] < at]
    if not inside:
        return ""
    start, stop, *_ = max(inside)
    lines = text[start:stop].split("\n")
    signature = "\n".join(lines[:SIGNATURE_LINES])
    return signature if size - len(signature) >= LEAST_ROOM else ""


def syntax_cuts(text: str, language: str, size: int = CHUNK_SIZE, found: list[tuple[int, int, int, str, str]] | None = None) -> list[tuple[int, int]]:
    """(start, end) of chunks that tile the text and end where a definition or statement does, where they can.

    Neighbouring pieces are packed up to ``size``, less the signature that a continuation repeats; a piece that
    is larger is cut by lines.
    """
    found = definitions(text, language) if found is None else found
    marks = {0, len(text)} | (_python_marks(text, size) if language == "python" else _brace_marks(text, language, size) if language in syntax.LANGUAGES else set())
    for d in found:
        marks |= {d[0], d[2]}
    marks = sorted(m for m in marks if 0 <= m <= len(text))
    cuts, at, room = [], 0, size
    for a, b in zip(marks, marks[1:], strict=False):
        if b - at <= room:
            continue
        if a > at:
            cuts.append((at, a))
            at, room = a, size - len(signature_of(text, found, a, size))
        while b - at > room:
            s, e = line_cuts(text[at : min(b, at + room + 1)], room)[0]
            cuts.append((at + s, at + e))
            at += e
            room = size - len(signature_of(text, found, at, size))
    if len(text) > at:
        cuts.append((at, len(text)))
    return cuts


def header_end(text: str) -> int:
    """Where the leading run of imports and the like ends: zero if there is none. What stands before it counts to
    it, and so do lines within its brackets."""
    at = end = depth = 0
    for line in text.split("\n"):
        at = min(at + len(line) + 1, len(text))
        if _HEADER.match(line) or depth > 0:
            depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
            end = at
        elif line.strip() and not line.lstrip().startswith(("#", "//", "/*", "*", '"')) and end:
            break
    return end


def chunk_file(text: str, path: str, size: int = CHUNK_SIZE) -> list[dict]:
    """Chunks of one file with their symbols; a file that cannot be parsed is cut by lines.

    Offsets tile the text. The content of a chunk that goes on with a definition begins with the definition's
    signature under a mark (``has_signature_context``).
    """
    dot = path.rfind(".")
    language = LANGUAGES.get(path[dot:].lower(), "") if dot > path.rfind("/") else ""
    try:
        found = definitions(text, language) if language else []
        cuts = syntax_cuts(text, language, size, found) if language else line_cuts(text, size)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        found, cuts = [], line_cuts(text, size)
    header, line, out = header_end(text) if language else 0, 1, []
    for k, (s, e) in enumerate(cuts):
        inside = [d for d in found if d[0] < e and d[2] > s]
        functions, classes = [d[3] for d in inside if d[4] == "function"], [d[3] for d in inside if d[4] == "class"]
        last, signature = line + text.count("\n", s, e), signature_of(text, found, s, size)
        out.append({
            "id": f"{path}:chunk_{k}", "content": (CONTINUED.format(signature) if signature else "") + text[s:e], "file_path": path, "chunk_index": k, "total_chunks": len(cuts), "start_line": line, "end_line": last, "start_char": s, "end_char": e,
            "prev_id": k - 1 if k else -1, "next_id": k + 1 if k + 1 < len(cuts) else -1,
            "function_name": functions[0] if functions else None, "class_name": classes[0] if classes else None,
            "symbol_type": "method" if functions and classes else "function" if functions else "class" if classes else None,
            "has_file_header": s < header or None, "is_continuation": any(d[0] < s for d in inside) or None,
            "has_signature_context": bool(signature) or None,
        })
        line = last
    return out


def chunk_files(files: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """``files`` (file_path, content) as chunks on syntax boundaries, in the schema of the chunk table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..schemas import CHUNKS

    arrow = pa.schema([f.with_nullable(True) for f in to_arrow_schema(CHUNKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rows := chunk_file(text or "", path, size):
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("file_path", "content").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNKS))


def nodes_of(text: str, path: str) -> list[tuple]:
    """(node, parent, kind, name, start_char, head_end, end_char, depth) of the definitions of a file, in order of their starts;
    ``parent`` is -1 for the outermost. A file that cannot be parsed, or is in no known language, has none."""
    dot = path.rfind(".")
    language = LANGUAGES.get(path[dot:].lower(), "") if dot > path.rfind("/") else ""
    try:
        found = definitions(text, language)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out, around = [], []
    for k, (start, head, end, name, kind) in enumerate(found):
        while around and found[around[-1]][2] <= start:
            around.pop()
        out.append((k, around[-1] if around else -1, kind, name, start, head, end, len(around)))
        around.append(k)
    return out


NODES = "node int, parent int, kind string, name string, start_char int, head_end int, end_char int, depth int"


def syntax_nodes(files: DataFrame) -> DataFrame:
    """The definitions of ``files`` (file_path, content) as a tree, see ``nodes_of``; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, *row) for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for row in nodes_of(text or "", path or "")]
            yield _batch(rows, _NODE_FIELDS)

    return files.select("file_path", "content").mapInArrow(run, f"file_path string, {NODES}")


_NODE_FIELDS = [("file_path", pa.string()), *[(c.split()[0], {"int": pa.int32(), "string": pa.string()}[c.split()[1]]) for c in NODES.split(", ")]]


def overlapping(spans: DataFrame, others: DataFrame, key: str, width: int = CHUNK_SIZE) -> DataFrame:
    """Pairs of ``spans`` (key, start, end, ...) and ``others`` (key, other_start, other_end, ...) that overlap.

    Both are put into every bin of ``width`` that they touch and meet there, so that a long file is no
    cross product; a pair is kept in the first bin both touch.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width)))
    (place,) = unused(spans.join(others, key), "bin")
    left, right = spans.withColumn(place, bins("start", "end")), others.withColumn(place, bins("other_start", "other_end"))
    first = F.floor(F.greatest("start", "other_start") / width)
    return left.join(right, [key, place]).where("start < other_end and other_start < end").where(F.col(place) == first).drop(place)


def expanded(chunks: DataFrame) -> DataFrame:
    """Add the text and lines of each chunk together with those before and after it in its file."""
    w = Window.partitionBy("file_path").orderBy("chunk_index")
    near = lambda c, d: F.lag(c, 1).over(w) if d < 0 else F.lead(c, 1).over(w)
    return chunks.withColumns({
        "expanded_content": F.concat_ws("\n", near("content", -1), F.col("content"), near("content", 1)),
        "expanded_start_line": F.coalesce(near("start_line", -1), "start_line"),
        "expanded_end_line": F.coalesce(near("end_line", 1), "end_line"),
    })


def expand_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` (file_path, chunk_index, ...) with the text and lines of each hit and its neighbours.

    The three places of a hit are joined to the chunks: only files with hits are touched, unlike ``expanded``.
    """
    wanted = hits.select("file_path", "chunk_index").distinct().withColumn("at", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index"), F.col("chunk_index") + 1)))
    texts = chunks.select("file_path", F.col("chunk_index").alias("at"), "content", "start_line", "end_line")
    met = wanted.join(texts, ["file_path", "at"]).groupBy("file_path", "chunk_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x.content), "\n").alias("expanded_content"),
        F.min_by("start_line", "at").alias("expanded_start_line"), F.max_by("end_line", "at").alias("expanded_end_line"))
    return hits.join(met, ["file_path", "chunk_index"], "left")


def get_chunk(chunks: DataFrame, file_path: str, chunk_index: int) -> DataFrame:
    return chunks.where((F.col("file_path") == file_path) & (F.col("chunk_index") == chunk_index))
