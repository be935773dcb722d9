"""Search results as compact text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DISPLAY_LIMIT, displayed


def header(path: Column, start: Column, end: Column, function_name: Column, class_name: Column) -> Column:
    """``path:start-end`` and the symbols; without a line number the path alone."""
    lines = F.when((F.coalesce(start, F.lit(0)) != 0) & (F.coalesce(end, F.lit(0)) != 0), F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(path)
    symbols = F.concat_ws(" | ", F.concat(F.nullif(function_name, F.lit("")), F.lit("()")), F.nullif(class_name, F.lit("")))
    return F.concat_ws(" ", lines, F.nullif(symbols, F.lit("")))


def render(hits: DataFrame, limit: int | None = DISPLAY_LIMIT) -> DataFrame:
    """(query_id, text) from hits with rank, file_path, lines, names and content, in order of rank.

    Expanded content and lines take the place of the others where the hits have them. ``limit`` None shows all.
    """
    has = lambda c: F.col(c) if c in hits.columns else F.lit(None)
    content = F.coalesce(has("expanded_content"), F.col("content"))
    head = header(F.col("file_path"), F.coalesce(has("expanded_start_line"), has("start_line")), F.coalesce(has("expanded_end_line"), has("end_line")), has("function_name").cast("string"), has("class_name").cast("string"))
    shown = displayed(content, limit) if limit else content
    block = F.concat_ws("\n", head, shown, F.lit("---"))
    return (hits.select("query_id", "rank", block.alias("block")).groupBy("query_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x.block), "\n").alias("text")))


def or_no_results(rendered: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for every query: those that found nothing say so."""
    return queries.select("query_id").join(rendered, "query_id", "left").select("query_id", F.coalesce("text", F.lit("No results.")).alias("text"))
