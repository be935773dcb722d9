"""Approximate nearest neighbours with a hierarchical k-means tree.

A tree of cluster centres is fitted on a bounded sample and every vector is put into the leaf it descends
to. A query takes leaves best bin first: a priority queue holds tree nodes by the distance of their centre,
the nearest is opened, and leaves are visited in the order they come out. How many leaves a query visits is
calibrated: exact neighbours of some queries show how far down that order they lie, and visits are widened
until the wanted recall is reached. Queries that then lack neighbours visit every leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, give_up, materialize, pieces, read_table

K = 10
#: Vectors the tree is fitted on, about, chosen by a hash of their row: so many, or so many for each leaf if that
#: is more. Leaves are the square root of the vectors, up to a bound, so the driver has 262,144 vectors at most.
SAMPLE, SAMPLE_A_LEAF = 30_000, 16
MOST_LEAVES = 16_384
BRANCHES = 8
#: Queries whose exact neighbours calibrate the visits, and the recall wanted of them.
CALIBRATION = 100
RECALL = 0.97
#: Vectors, and queries, of a leaf that meet in one task at most, about.
BLOCK = 4_096


class Tree:
    """Centres of all nodes, the children of inner nodes, and the number of each leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        size = max(1, len(sample) // max(1, leaves))
        self._grow(sample, size, np.random.default_rng(seed))
        self.matrix = np.array(self.centres)

    def _grow(self, x: np.ndarray, size: int, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(x.mean(0))
        self.children.append([])
        self.leaf.append(-1)
        parts = _kmeans(x, BRANCHES, rng) if len(x) > size else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(p, size, rng) for p in parts]
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each vector descends to."""
        out = np.empty(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            nearest = _distances(x[rows], self.matrix[self.children[node]]).argmin(1)
            stack += [(c, rows[nearest == i]) for i, c in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def order(self, x: np.ndarray, visits: int) -> list[list[int]]:
        """For each query the first ``visits`` leaves, best bin first."""
        far, out = _distances(x, self.matrix), []
        for d in far.tolist():
            queue, found = [(0.0, 0)], []
            while queue and len(found) < visits:
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for c in self.children[node]:
                        heapq.heappush(queue, (d[c], c))
                else:
                    found.append(self.leaf[node])
            out.append(found)
        return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> list[np.ndarray]:
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return []
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        centres = np.array([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
    near = _distances(x, centres).argmin(1)
    return [x[near == i] for i in range(len(centres)) if (near == i).any()]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, embedding) that take part, ``row`` being a number of each row's own.

    Left out: null ids; vectors that are null, empty, all zero, or hold null or non-finite components.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
            .where(finite & F.exists("embedding", lambda v: v != 0)))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"))


def _top(k: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, of the row, distance) of each query's nearest, up to ``k``."""
    asked, found, far = [], [], []
    for i, (own, v) in enumerate(zip(query_rows.tolist(), q, strict=True)):
        d = np.sqrt(((x - v) ** 2).sum(1))
        d[rows == own] = np.inf
        best = np.lexsort((ids, d))[:k] if len(d) <= 4 * k else _nearest(d, ids, k)
        best = best[np.isfinite(d[best])]
        asked.append(np.full(len(best), i))
        found.append(best)
        far.append(d[best])
    return tuple(np.concatenate(c) if c else np.empty(0, int) for c in (asked, found, far))


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # with all ties
    return some[np.lexsort((ids[some], d[some]))[:k]]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _exact(leaved: DataFrame, query_rows: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries: each task's nearest, then the nearest of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches, 4_096):
            i, at, d = _top(k, b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)), query_rows, q)
            yield pa.RecordBatch.from_arrays([pa.array(query_rows[i]), b.column(1).take(pa.array(at)), pa.array(d, pa.float64()), b.column(3).take(pa.array(at))], ["query_row", "vec_id", "score", "leaf"])

    return _ranked(leaved.where("leaf >= 0").select("row", "vec_id", "embedding", "leaf").mapInArrow(run, "query_row long, vec_id long, score double, leaf long"), k)


def _visit(leaved: DataFrame, queries: DataFrame, tree_b, visits: int, leaf_sizes: dict[int, int], k: int) -> DataFrame:
    """Nearest vectors in the leaves that each query visits: (query_row, query_id, vec_id, score), up to ``k`` a block."""
    spark = leaved.sparkSession

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches, 64):
            own = b.column(2).to_numpy()
            orders = [[leaf] for leaf in own.tolist()]  # vectors of another length have one leaf of theirs
            at = np.flatnonzero(own >= 0)
            if len(at):
                for i, o in zip(at.tolist(), tree_b.value.order(_matrix(b.column(1).take(pa.array(at))), visits), strict=True):
                    orders[i] = o
            rows = np.repeat(np.arange(b.num_rows), [len(o) for o in orders])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([l for o in orders for l in o], pa.int64())], ["query_row", "leaf"])

    pairs = materialize(queries.select("query_row", "embedding", "leaf").mapInArrow(probe, "query_row long, leaf long"), 4_096)
    asked = {r.leaf: r.n for r in pairs.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_LEAVES rows, and one for each other length
    blocks = spark.createDataFrame(
        [(l, -(-leaf_sizes.get(l, 0) // BLOCK), -(-n // BLOCK)) for l, n in asked.items() if leaf_sizes.get(l)], "leaf long, v_blocks int, q_blocks int")
    blocks = F.broadcast(blocks)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    q = (pairs.join(blocks, "leaf").join(queries.drop("leaf"), "query_row")
         .select("leaf", part("query_row", "q_blocks").alias("q_block"), each("v_blocks").alias("v_block"), "query_row", "query_id", F.col("embedding").alias("q")))
    v = (leaved.join(blocks, "leaf")
         .select("leaf", each("q_blocks").alias("q_block"), part("row", "v_blocks").alias("v_block"), "row", "vec_id", "embedding"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names], names)
        i, at, d = _top(k, right["row"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["embedding"].combine_chunks()), left["query_row"].to_numpy(), _matrix(left["q"].combine_chunks()))
        i, at = pa.array(i, pa.int64()), pa.array(at, pa.int64())
        return pa.table([left["query_row"].take(i), left["query_id"].take(i), right["vec_id"].take(at), pa.array(d, pa.float64())], names)

    keys = ["leaf", "q_block", "v_block"]
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(meet, "query_row long, query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each usable row where ``is_query`` holds.

    ``vectors`` has vec_id and embedding; see ``usable_vectors`` for what takes part. A query's own row is no
    candidate, others of its id are; a query id of several rows has several lists. The score is the Euclidean distance
    in double precision, ties go to the smaller id, and with fewer than ``k`` candidates all are returned. The tree
    is of vectors of the commonest length (of equally common, the larger); vectors of another length are compared
    with all of theirs. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    size = F.size("embedding")
    lengths = rows.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, n = lengths[0].d, lengths[0].n
    leaves = min(MOST_LEAVES, max(1, round(n**0.5)))
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / (1 << 30)  # by row: an id may have many
    common = rows.where(size == dim).select("row", "embedding")
    sample = common.where(draw < min(1.0, max(SAMPLE, SAMPLE_A_LEAF * leaves) / n)).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(sample):
        sample = common.select("embedding").limit(1).toArrow()["embedding"].combine_chunks()
    tree = Tree(_matrix(sample), leaves)
    tree_b = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches, 4_096):
            long = pc.list_value_length(b.column(2)).to_numpy()
            leaf = -long.astype(np.int64)
            at = np.flatnonzero(long == dim)
            if len(at):
                leaf[at] = tree_b.value.assign(_matrix(b.column(2).take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(leaf)], ["row", "vec_id", "embedding", "leaf"])

    leaved = materialize(rows.mapInArrow(assign, "row long, vec_id long, embedding array<double>, leaf long"), 4_096)
    leaf_sizes = {r.leaf: r.n for r in leaved.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    queries = materialize(leaved.where(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "embedding", "leaf"))
    discard(rows)
    if queries.isEmpty():
        return spark.createDataFrame([], schema)
    some = queries.where("leaf >= 0").orderBy(F.xxhash64("query_id", F.lit(1)), "query_row").limit(CALIBRATION).toArrow()
    visits = 1
    if some.num_rows:
        q, asked = _matrix(some["embedding"].combine_chunks()), some["query_row"].to_numpy()
        true = _exact(leaved, asked, q, k).select("query_row", "leaf").collect()
        places = {i: {l: p for p, l in enumerate(o)} for i, o in zip(asked.tolist(), tree.order(q, tree.leaves), strict=True)}
        depth = sorted(places[r.query_row][r.leaf] + 1 for r in true)
        visits = depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)] if depth else 1
    found = materialize(_ranked(_visit(leaved, queries, tree_b, visits, leaf_sizes, k), k), 4_096)
    short = (queries.where("leaf >= 0").join(found.groupBy("query_row").agg(F.count(F.lit(1)).alias("n")), "query_row", "left")
             .where(F.coalesce("n", F.lit(0)) < min(k, n - 1)).select(queries.columns))
    short = materialize(short)
    columns = ["query_id", "rank", "vec_id", "score"]
    if short.isEmpty():
        return found.select(columns)
    rest = _ranked(_visit(leaved, short, tree_b, tree.leaves, leaf_sizes, k), k).select(columns)
    return found.join(short.select("query_row"), "query_row", "left_anti").select(columns).unionByName(rest)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of the vectors whose id is divisible by 100; see ``search``."""
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
