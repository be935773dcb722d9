"""Scalar expressions over paths and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISPLAY_LIMIT = 600


def collection_name(path: Column, prefix: str = "codebase_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(path, 256), 1, 16))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit(":chunk_"), index.cast("string"))


def line_number(content: Column, offset: Column) -> Column:
    """Line, from one, that the character at ``offset`` (from zero) is in."""
    return F.regexp_count(F.substring(content, F.lit(1), offset.cast("int")), F.lit("\n")) + 1


def one_line(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def with_prefix(query: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), query)


def displayed(content: Column, limit: int = DISPLAY_LIMIT) -> Column:
    """The content, or its first ``limit`` characters and an ellipsis."""
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit("…"))).otherwise(content)


def rerank_context(path: Column, class_name: Column, function_name: Column, content: Column) -> Column:
    """File, class, function and code, as a reranker sees them; empty and absent parts are left out."""
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.nullif(c, F.lit("")))
    return F.concat_ws(" | ", F.concat(F.lit("File: "), F.coalesce(path, F.lit("Unknown"))), part("Class", class_name), part("Function", function_name), F.concat(F.lit("Code: "), content))
