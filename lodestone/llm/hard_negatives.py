"""Hard negatives with bounds along a spanning tree of the anchors.

Scores are inner products. The anchors of a turn are the nodes of trees of shortest edges. A candidate's score is computed at
the root of a tree; on the way down its score at a child lies within the score at the parent plus or minus the
length of the edge times the candidate's norm, and where the parent was only bounded, within its bounds
widened by that much. A candidate is scored at a child only where its bounds meet the window that is asked for:
first the places among an anchor's positives, then the shares of a positive's score. Both windows become narrower as a task finds
better rows, so the bounds save more and more; they never leave out a row that belongs to the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, give_up, materialize, pieces, read_table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from ``LOW`` to ``HIGH`` hundredths of the positive's.
LOW, HIGH = 30, 90
#: Components become ``floor(SCALE * x)``.
SCALE = 256
#: Anchors that are sent to all rows at once, and anchors of one tree: both bound memory, not the result.
TURN, TREE = 4_096, 512
#: Candidates that go down a tree together.
BLOCK = 4_096
#: Rows of a larger norm take no part: products could leave 64 bits.
MOST_NORM = float(1 << 31)
_FAR = np.iinfo(np.int64).max


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v) that take part: ``v`` the whole numbers ``floor(256 * x)``, ``row`` a number of the row's own.

    Left out: null ids, labels and vectors, empty vectors, those with null or non-finite components, and those whose whole
    numbers have a norm over 2 ** 31, as their products might not fit a long.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x * SCALE).cast("long"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (F.abs(x * SCALE) + 1) ** 2))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
            .where(finite).where(norm <= MOST_NORM)
            .select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("v")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Whole numbers as doubles where no product of two rows can leave their 53 bits, else as longs."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x.astype(np.float64) if (x.astype(np.float64) ** 2).sum(1).max(initial=0) < 2.0**52 else x


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms, rounded up."""
    return np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)


@dataclass
class Tree:
    """Anchors in an order in which a parent comes before its children."""

    x: np.ndarray
    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    parent: np.ndarray
    edge: np.ndarray  # length of the edge to the parent, rounded up


def spanning_trees(anchors: pa.Table, most: int = TREE) -> list[Tree]:
    """Trees of shortest edges over anchors (row, vec_id, label, v), for each length of vectors and so many anchors."""
    out = []
    long = np.array([len(v) for v in anchors["v"]])
    for d in np.unique(long):
        own = anchors.take(pa.array(np.flatnonzero(long == d)))
        own = own.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])
        for k in range(0, own.num_rows, most):
            part = own.slice(k, most)
            out.append(_tree(_matrix(part["v"].combine_chunks()), *(part[c].to_numpy() for c in ("row", "vec_id", "label"))))
    return out


def _tree(x: np.ndarray, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray) -> Tree:
    """Prim's tree, from the anchor nearest to the mean on."""
    f = x.astype(np.float64)
    n = len(f)
    at = int(((f - f.mean(0)) ** 2).sum(1).argmin())
    near, parent, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    order, place, parents, edges = [], np.zeros(n, np.int64), [], []
    while True:
        place[at] = len(order)
        order.append(at)
        parents.append(-1 if parent[at] < 0 else int(place[parent[at]]))
        edges.append(0.0 if parent[at] < 0 else float(np.sqrt(near[at]) * (1 + 1e-12)))
        left[at] = False
        if not left.any():
            break
        d = ((f - f[at]) ** 2).sum(1)
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.where(left, near, np.inf).argmin())
    order = np.array(order)
    return Tree(x[order], row[order], vec_id[order], label[order], np.array(parents), np.array(edges))


class _Best:
    """The first so many (score, vec_id, row) of each list, higher scores and then smaller ids first."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score, self.vec_id, self.row = (np.full((lists, k), v, np.int64) for v in (-_FAR, _FAR, _FAR))

    def least(self, i) -> np.ndarray:
        """The score that a further row must reach: that of the last one, or none while a list is short."""
        return self.score[i, self.k - 1]

    def take(self, i: int, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        score, vec_id, row = (np.concatenate((a[i], b)) for a, b in ((self.score, score), (self.vec_id, vec_id), (self.row, row)))
        order = np.lexsort((row, vec_id, -score))[: self.k]
        self.score[i], self.vec_id[i], self.row[i] = score[order], vec_id[order], row[order]


def descend(tree: Tree, x: np.ndarray, same: np.ndarray, wanted, found) -> int:
    """Take candidates ``x`` down the tree; returns how many scores were computed.

    ``same[i]`` marks the candidates that anchor ``i`` may take, ``wanted(i)`` is its window (low, high) of scores, and
    ``found(i, at, scores)`` gets the candidates whose exact scores lie in it.
    """
    norm = _norms(x)
    low, high = np.empty((len(tree.parent), len(x))), np.empty((len(tree.parent), len(x)))
    scored = 0
    for i, p in enumerate(tree.parent):
        if p < 0:
            at = np.arange(len(x))
        else:
            reach = tree.edge[i] * norm
            slack = 1e-12 * reach + 1e-12 * np.maximum(np.abs(low[p]), np.abs(high[p])) + 1e-6
            low[i], high[i] = low[p] - reach - slack, high[p] + reach + slack
            least, most = wanted(i)
            at = np.flatnonzero(same[i] & (high[i] >= least) & (low[i] <= most))
        if len(at):
            exact = (x if len(at) == len(x) else x[at]) @ tree.x[i].astype(x.dtype)
            scored += len(at)
            low[i, at] = high[i, at] = exact
            least, most = wanted(i)
            fits = same[i, at] & (exact >= least) & (exact <= most)
            if fits.any():
                found(i, at[fits], exact[fits].astype(np.int64))
    return scored


def _blocks(batches: Iterator[pa.RecordBatch], trees: list[Tree]):
    """(tree number, row, vec_id, label, x) of candidates, for every tree of vectors as long as theirs."""
    for b in pieces(batches, BLOCK):
        long = np.array([len(v) for v in b.column(3)])
        for d in np.unique(long):
            at = np.flatnonzero(long == d)
            some = b if len(at) == b.num_rows else b.take(pa.array(at))
            x = _matrix(some.column(3))
            row, vec_id, label = (some.column(k).to_numpy() for k in range(3))
            for t, tree in enumerate(trees):
                if tree.x.shape[1] == d:
                    yield t, row, vec_id, label, x if x.dtype == tree.x.dtype else x.astype(np.int64)


def _as_longs(trees: list[Tree]) -> None:
    """Trees of longs and of doubles do not mix."""
    if any(t.x.dtype != np.float64 for t in trees):
        for t in trees:
            t.x = t.x.astype(np.int64)


def _positives(rows: DataFrame, trees, k: int) -> DataFrame:
    """(anchor_row, positive_id, positive_score, place) of each anchor's first ``k`` other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        best = [_Best(len(t.row), k) for t in trees.value]
        for t, row, vec_id, label, x in _blocks(batches, trees.value):
            tree, own = trees.value[t], best[t]
            same = (label == tree.label[:, None]) & (row != tree.row[:, None])
            descend(tree, x, same, lambda i: (own.least(i), _FAR), lambda i, at, s: own.take(i, s, vec_id[at], row[at]))
        for tree, own in zip(trees.value, best, strict=True):
            i, j = np.nonzero(own.row < _FAR)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tree.row[i], own.vec_id[i, j], own.row[i, j], own.score[i, j])], ["anchor_row", "positive_id", "positive_row", "positive_score"])

    found = rows.select("row", "vec_id", "label", "v").mapInArrow(run, "anchor_row long, positive_id long, positive_row long, positive_score long")
    w = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("positive_row")


def _negatives(rows: DataFrame, trees, asked, k: int, low: int, high: int) -> DataFrame:
    """(anchor_row, place, negative_id, negative_score, rank) of the first ``k`` rows in each positive's window.

    ``asked`` has for each tree the scores of its anchors' positives (0 at most: no whole number is the 30th to the 90th
    part of a negative one), NaN where there are fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        # whole numbers of scores: the least and the most that fit
        least = [[[-(-low * s // 100) if s is not None else _FAR for s in own] for own in tree] for tree in asked.value]
        most = [[[high * s // 100 if s is not None else -_FAR for s in own] for own in tree] for tree in asked.value]
        least, most = [np.array(a, np.int64) for a in least], [np.array(a, np.int64) for a in most]
        best = [_Best(a.size, k) for a in least]
        for t, row, vec_id, label, x in _blocks(batches, trees.value):
            tree, own, lo, hi, wide = trees.value[t], best[t], least[t], most[t], least[t].shape[1]

            def wanted(i, own=own, lo=lo, hi=hi, wide=wide):
                bar = np.maximum(lo[i], own.least(slice(i * wide, i * wide + wide)))
                some = bar <= hi[i]
                return (bar[some].min(), hi[i][some].max()) if some.any() else (_FAR, -_FAR)

            def found(i, at, s, own=own, lo=lo, hi=hi, wide=wide, vec_id=vec_id, row=row):
                for j in range(wide):
                    fits = (s >= max(lo[i, j], own.least(i * wide + j))) & (s <= hi[i, j])
                    if fits.any():
                        own.take(i * wide + j, s[fits], vec_id[at[fits]], row[at[fits]])

            descend(tree, x, label != tree.label[:, None], wanted, found)
        for tree, own, a in zip(trees.value, best, least, strict=True):
            i, j = np.nonzero(own.row < _FAR)
            wide = max(1, a.shape[1])
            columns = (tree.row[i // wide], i % wide + 1, own.vec_id[i, j], own.row[i, j], own.score[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_row", "place", "negative_id", "negative_row", "negative_score"])

    found = rows.select("row", "vec_id", "label", "v").mapInArrow(run, "anchor_row long, place long, negative_id long, negative_row long, negative_score long")
    w = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("negative_row")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, turn: int = TURN, tree: int = TREE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of ``vectors``.

    ``vectors`` has vec_id, label and embedding; see ``usable_rows`` for what takes part. Anchors are the usable rows where
    ``is_anchor`` holds, a column over vec_id and label. The score of two rows is the inner product of their whole numbers;
    rows whose vectors have another length than the anchor's have none. An anchor's positives are its first ``positives`` other rows
    of its label, and each one's negatives the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``; higher scores come first, ties by smaller id. So a
    positive below 0 has none. Repeated ids are rows of their own, and repeated anchors have lists of their own.
    Empty tables give no rows; other columns are ignored.

    Anchors are a set of queries against all rows: ``turn`` of them are broadcast at once, and each turn's result is written
    before the next, so more anchors take more passes and not more memory. Results are exact.
    """
    spark = vectors.sparkSession
    rows = materialize(usable_rows(vectors), BLOCK)
    anchors = materialize(rows.where(is_anchor))
    total = anchors.count()
    turns = max(1, -(-total // turn))
    part = F.pmod(F.xxhash64("row"), F.lit(turns))
    out = None
    for k in range(turns if total else 0):
        trees = spanning_trees(anchors.where(part == k).select("row", "vec_id", "label", "v").toArrow().combine_chunks(), tree)
        if not trees:
            continue
        _as_longs(trees)
        trees_b = spark.sparkContext.broadcast(trees)
        found = materialize(_positives(rows, trees_b, positives), BLOCK)
        scores = {(r.anchor_row, r.place): r.positive_score for r in found.select("anchor_row", "place", "positive_score").toLocalIterator()}  # of a turn
        asked = spark.sparkContext.broadcast([[[scores.get((row, j + 1)) for j in range(positives)] for row in t.row.tolist()] for t in trees])
        own = found.join(_negatives(rows, trees_b, asked, negatives, low, high), ["anchor_row", "place"]).join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
        own = own.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        own = materialize(own) if turns > 1 else own
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose id is divisible by
    100, after the labels of ids divisible by 7 moved on by one; see ``mine``."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
