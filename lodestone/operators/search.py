"""Vector search and what ranks, filters and lifts its results.

Vectors are compared in blocks: each task multiplies its rows with the matrix of a stated, bounded set of
queries and hands on the nearest of all its rows, so a search is one pass over the chunks and a small sort. More
queries are searched in turns, each written before the next is sent.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identifiers as ident
from ..functions.columns import unused
from ..functions.text import rerank_context
from ..sources.filters import in_paths, of_types
from ..sources.scratch import materialize

RESULTS = 5
TOOL_CAP = 20
#: Queries that are sent to every task at once; more are searched in turns of so many.
QUERIES_AT_ONCE = 20_000
#: Distances a task holds at once.
PRODUCT = 4_000_000
#: Nearest rows that a task hands on together.
SENT = 1 << 17
#: Rows found that wait at most until they are cut to the nearest.
WAITING = 1 << 19


def fetch_size(n: int, filtered: bool = False, rerank_multiplier: int = 1) -> int:
    """How many a search fetches before filters and reranking cut it down to ``n``."""
    return (max(10 * n, 50) if filtered else n) * max(1, rerank_multiplier)


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` chunks of smallest cosine distance to each query.

    Distances are exact, in double precision to 12 decimals; ties go to the smaller id. Vectors that are null,
    zero, or hold null or non-finite numbers take no part, nor do chunks whose vector has another length than the
    query's. With fewer chunks than ``k`` all are returned. ``queries`` has query_id and the vector column.
    """
    spark = chunks.sparkSession
    kind, query_kind = chunks.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rows = chunks.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    asked = queries.where(F.col(vector_col).isNotNull()).select("query_id", F.col(vector_col).alias("v"))
    turns = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    found = None
    for turn in range(turns):
        some = asked if turns == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        shared = spark.sparkContext.broadcast(_by_length(some.toArrow()))
        part = _ranked(_nearest(rows, shared, k, kind, query_kind), k)
        if turns > 1:
            part = materialize(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "distance")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(asked: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Names and unit vectors of queries, for each length of vectors."""
    names, vectors = asked["query_id"].combine_chunks(), asked["v"].combine_chunks()
    if not len(names):
        return {}
    length = pc.list_value_length(vectors).to_numpy()
    picked = {int(n): pa.array(np.flatnonzero(length == n)) for n in np.unique(length) if n}
    return {n: (names.take(at), _unit(_matrix(vectors.take(at)))) for n, at in picked.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(rows: DataFrame, shared, k: int, kind: str, query_kind: str) -> DataFrame:
    """(query_id, id, distance): of each task's rows the ``k`` nearest to each query, so at most as many as queries times ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = {n: _Best(len(names), k) for n, (names, _) in shared.value.items()}, None
        for b in batches:
            id_type = b.column(0).type
            length = pc.list_value_length(b.column(1)).to_numpy()
            for n, (_, q) in shared.value.items():
                at = np.flatnonzero(length == n)
                step = max(1, PRODUCT // len(q))
                for s in range(0, len(at), step):
                    own = pa.array(at[s : s + step])
                    near = np.round(1 - q @ _unit(_matrix(b.column(1).take(own))).T, 12)
                    near[~np.isfinite(near)] = np.inf
                    best[n].add(near, np.array(b.column(0).take(own).to_pylist()))
        for n, (names, _) in shared.value.items():
            best[n].merge()
            for s in range(0, len(best[n].query), SENT):
                some = slice(s, s + SENT)
                ids = pa.array(best[n].ids[some].tolist(), id_type)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(best[n].query[some])), ids, pa.array(best[n].distance[some])], ["query_id", "id", "distance"])

    return rows.mapInArrow(run, f"query_id {query_kind}, id {kind}, distance double")


class _Best:
    """The ``k`` nearest rows of each query among those seen so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, np.full(queries, np.inf)  # beyond it nothing more is taken
        self.query, self.distance, self.ids = np.empty(0, np.int64), np.empty(0), None
        self.fresh, self.n = [], 0

    def add(self, near: np.ndarray, ids: np.ndarray) -> None:
        """Rows of these ``ids`` with their distances ``near`` to each query, infinite for none."""
        if near.shape[1] > self.k:
            # of a block no more than its own k nearest, with all ties
            many = np.flatnonzero((near <= self.limit[:, None]).sum(1) > self.k)
            self.limit[many] = np.minimum(self.limit[many], np.partition(near[many], self.k - 1, axis=1)[:, self.k - 1])
        i, j = np.nonzero((near <= self.limit[:, None]) & (near < np.inf))
        if len(i):
            self.fresh.append((i, near[i, j], ids[j]))
            self.n += len(i)
        if self.n > max(WAITING, len(self.query)):
            self.merge()

    def merge(self) -> None:
        """Cut what was added, with what was kept before, to ``k`` a query."""
        if not self.fresh:
            return
        kept = [] if self.ids is None else [(self.query, self.distance, self.ids)]
        query, distance, ids = map(np.concatenate, zip(*kept, *self.fresh, strict=True))
        self.fresh, self.n = [], 0
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, distance, query))
        size = np.bincount(query, minlength=len(self.limit))
        order = order[np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size) < self.k]
        self.query, self.distance, self.ids = query[order], distance[order], ids[order]
        full = size >= self.k
        self.limit[full] = np.minimum(self.limit[full], self.distance[np.cumsum(np.minimum(size, self.k))[full] - 1])


def filter_hits(hits: DataFrame, file_types=None, include_paths=None) -> DataFrame:
    """Hits whose file_path has one of the suffixes and one of the strings."""
    return hits.where(of_types(F.col("file_path"), file_types) & in_paths(F.col("file_path"), include_paths))


def rerank(hits: DataFrame, score: Column, top_k: int) -> DataFrame:
    """The ``top_k`` of each query by ``score``, larger first; equal ones keep their order. ``similarity`` becomes
    the score."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "rank")
    return hits.withColumn("similarity", score).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top_k).drop("rank").withColumnRenamed("new_rank", "rank")


def rerank_with(hits: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], top_k: int) -> DataFrame:
    """Rerank by a model: ``load`` makes, once a task, a function from (query, context) pairs to scores.

    The context is the file, class, function and code of a hit. If the model answers nothing for a batch, or fails,
    its hits keep their order: their score is ``1 - distance``.
    """
    names, (shown, made) = hits.columns, unused(hits, "context", "score")
    optional = lambda c: F.col(c) if c in names else F.lit(None).cast("string")
    context = rerank_context(optional("file_path"), optional("class_name"), optional("function_name"), F.col("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            score = load()
        except Exception:  # noqa: BLE001
            score = lambda pairs: []
        for b in batches:
            scores: list[float] = []
            if b.num_rows:
                with contextlib.suppress(Exception):  # a search without its reranker is better than none
                    scores = score(list(zip(b.column("query").to_pylist(), b.column(shown).to_pylist(), strict=True)))
            values = pa.array(scores, pa.float64()) if len(scores) == b.num_rows else pa.array([1 - d for d in b.column("distance").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), values], [*names, made])

    schema = T.StructType([*hits.schema.fields, T.StructField(made, T.DoubleType())])
    scored = hits.withColumn(shown, context).mapInArrow(run, schema)
    return rerank(scored, F.col(made), top_k).drop(made)


def boost_hits(hits: DataFrame, query: Column, n: int, strict_limit: bool = True) -> DataFrame:
    """Lift ``similarity`` by the query's identifiers in ``content``, sort again, and keep ``n`` a query.

    ``original_similarity`` is set, and the order changes, only for queries that have identifiers. Without
    ``strict_limit`` the others are not cut.
    """
    names = ident.identifiers(query)
    named = F.size(names) > 0
    matches = F.when(named, ident.identifier_matches(names, ident.words_of(F.col("content")))).otherwise(0)
    factor = F.when(named, ident.boost(names, ident.significant_words(query), F.col("content"))).otherwise(1.0)
    hits = hits.withColumns({"original_similarity": F.when(named, F.col("similarity")), "boosted": matches > 0, "similarity": F.col("similarity") * factor})
    w = Window.partitionBy("query_id").orderBy(F.desc(F.when(named, F.col("similarity")).otherwise(F.lit(0.0))), "rank")
    hits = hits.withColumn("new_rank", F.row_number().over(w))
    keep = F.col("new_rank") <= n
    return hits.where(keep if strict_limit else keep | ~named).drop("rank").withColumnRenamed("new_rank", "rank")


def search(chunks: DataFrame, queries: DataFrame, n: int = RESULTS, file_types=None, include_paths=None, compat: bool = False,
           rerank_score: Column | None = None, rerank_multiplier: int = 2, expand: bool = False, rerank_words: bool = False) -> DataFrame:
    """Search ``chunks`` for ``queries`` (query_id, query, embedding).

    Filters apply before the nearest are taken, so ``n`` results come if there are ``n``; with ``compat`` they
    apply after a larger fetch, and fewer may be left. ``rerank_score`` is an expression over query and
    chunk columns; ``rerank_words`` reranks by the late interaction of words, which needs no model.
    """
    from .chunking import expand_hits
    from .interaction import with_interaction, word_weights

    filtered = bool(file_types or include_paths)
    k = fetch_size(n, filtered and compat, rerank_multiplier if rerank_score is not None or rerank_words else 1)
    base = chunks if compat else filter_hits(chunks, file_types, include_paths)
    hits = vector_topk(base, queries.select("query_id", "embedding"), k)
    hits = hits.join(chunks.drop("embedding"), "id").join(F.broadcast(queries.select("query_id", "query")) if queries.count() <= QUERIES_AT_ONCE else queries.select("query_id", "query"), "query_id")
    hits = hits.withColumn("similarity", 1 - F.col("distance"))
    if compat:
        hits = filter_hits(hits, file_types, include_paths)
    if rerank_score is not None:
        hits = rerank(hits, rerank_score, n)
    elif rerank_words:
        (own,) = unused(hits, "score")
        hits = rerank(with_interaction(hits, word_weights(chunks, queries), own), F.col(own), n).drop(own)
    hits = boost_hits(hits, F.col("query"), n)
    return expand_hits(hits, chunks) if expand else hits
