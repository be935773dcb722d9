"""One call from a question to text: index what is needed, search, and render."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings, load
from ..operators import embedding, render, search
from .indexing import CHUNKS, Index


def hashed_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query, embedding); a query without words has no embedding and finds nothing."""
    return embedding.with_hash_embedding(queries, "query").withColumn("embedding", F.col("embedding").cast("array<float>"))


def search_codebase(spark: SparkSession, root: str, queries: str | list[str], n: int | None = None, settings: Settings | None = None, file_types=None, include_paths=None, expand: bool = True,
                    rerank_score: Column | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, embed_queries: Callable[[DataFrame], DataFrame] = hashed_queries, full: bool = False,
                    model: Callable[[], embedding.Embedder] | None = None, model_name: str = "hash") -> list[str]:
    """The rendered results of each query over the tree at ``root``, which is indexed first where it must be.

    ``n`` is cut at the tool's cap. ``model`` makes an embedder for chunks and queries, ``settings.batch_size``
    texts at once; ``embed`` and ``embed_queries`` do it in other ways. Raises ``ValueError`` if the folder does not look like a codebase.
    """
    settings = settings or load()
    dimension = None
    if model is not None:
        batch, dimension = settings.batch_size, model().dimension
        embed, embed_queries = lambda rows: embedding.embed(rows, model, batch=batch), lambda rows: embedding.embed(rows, model, "query", query=True, batch=batch)
    asked = [queries] if isinstance(queries, str) else list(queries)
    index = Index(spark, settings.store_path, root, embed=embed, chunk_size=settings.chunk_size, exclude_tests=settings.exclude_tests, additional_ignored=settings.additional_ignored, model_name=model_name, dimension=dimension)
    if index.ensure(settings.debounce_minutes, verify_with_hash=settings.verify_with_hash)["status"] == "not_a_codebase":
        raise ValueError(f"{root} does not look like a codebase")
    schema = T.StructType([T.StructField("query_id", T.IntegerType()), T.StructField("query", T.StringType())])
    table = embed_queries(spark.createDataFrame(list(enumerate(asked)), schema)).persist()
    try:
        found = search.search(index.store.table(CHUNKS), table, n=min(n or settings.results, search.TOOL_CAP), file_types=file_types, include_paths=include_paths, expand=expand,
                              rerank_score=rerank_score, rerank_multiplier=settings.rerank_multiplier)
        rows = render.or_no_results(render.render(found, None if full else render.DISPLAY_LIMIT), table).collect()
    finally:
        table.unpersist()
    return [r.text for r in sorted(rows, key=lambda r: r.query_id)]
