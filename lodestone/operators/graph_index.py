"""A stored index of nearest neighbours: a navigable graph for each part of a collection.

Rows are dealt into parts by a hash of their id. In a part every vector is linked with near ones, of which those are kept that no kept
one is nearer to, so that links lead away in all directions; links go both ways. A search begins at the nearest of some entry
points and follows links from the best vectors it knows, for many queries at once, and the parts' finds are ranked together.
New rows are linked into their parts, deleted ones still lead on but are no longer found, until a part has so many of
them that it is built again. Only parts with changes are read and written.

The graph is a collection of a ``Store``, a row a part, so changes are commits and older versions stay readable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .store import Store

#: Vectors of a part, about.
PART = 16_384
#: Near vectors that links are chosen from, links chosen, and links that a vector has at most.
CANDIDATES, LINKS, MOST = 48, 16, 40
#: Entry points of a part are this many times the root of its size, chosen from a sample; a search keeps so many vectors in view.
ENTRIES, SAMPLE, BEAM = 2, 4_096, 96
#: A part is built again once this share of it is deleted.
DEAD = 0.3
#: Queries that are sent to all parts at once.
QUERIES_AT_ONCE = 10_000
#: Queries that go through a part together, rows whose candidates are compared with one another at once, and products, of rows with
#: a part or of numbers in pairs, that are held at once; so a part takes little more memory than its vectors and links.
TOGETHER, ROWS, PRODUCT = 512, 256, 2_000_000
COLLECTION = "graph"
_STATE = "part string, dimension int, ids array<{0}>, vectors array<float>, links array<int>, alive array<boolean>, entries array<int>"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _nearest(x: np.ndarray, rows: np.ndarray, k: int, pool: np.ndarray) -> np.ndarray:
    """For each of ``rows`` the ``k`` most alike of ``pool`` (both numbers of vectors), nearest first; -1 where there are fewer."""
    out = np.full((len(rows), k), -1)
    own, step = x[pool], max(1, PRODUCT // max(1, len(pool)))
    for s in range(0, len(rows), step):
        some = rows[s : s + step]
        far = x[some] @ own.T
        np.negative(far, out=far)
        far[some[:, None] == pool] = np.inf
        m = min(k, len(pool))
        best = np.argpartition(far, m - 1, axis=1)[:, :m]
        order = np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        out[s : s + len(some), :m] = np.where(np.isfinite(np.take_along_axis(far, best, 1)), pool[best], -1)
    return out


def _spread(x: np.ndarray, rows: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those that no chosen one is nearer to than the row is; -1 for none."""
    out = np.full((len(rows), most), -1)
    for s in range(0, len(rows), ROWS):
        c = near[s : s + ROWS]
        v = x[np.maximum(c, 0)]
        to_row = np.einsum("ikd,id->ik", v, x[rows[s : s + ROWS]])
        to_row[c < 0] = -np.inf
        between = np.einsum("ikd,ijd->ikj", v, v)
        kept = np.zeros(c.shape, bool)
        for k in range(c.shape[1]):
            hidden = (kept[:, :k] & (between[:, k, :k] > to_row[:, k : k + 1])).any(1)
            kept[:, k] = ~hidden & (c[:, k] >= 0) & (kept.sum(1) < most)
        # what room is left goes to the nearest of the others
        rank = np.argsort(~kept * 1_000 + (c < 0) * 1_000_000 + np.arange(c.shape[1]), axis=1, kind="stable")[:, :most]
        out[s : s + len(c), : rank.shape[1]] = np.take_along_axis(c, rank, 1)
    return out


def _both_ways(x: np.ndarray, links: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """``links`` with those ``chosen`` for ``rows`` and the same the other way round; who then has too many keeps a spread of them."""
    n = len(x)
    a, b = np.repeat(rows, chosen.shape[1]), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    have = np.flatnonzero(links.ravel() >= 0)
    a, b = np.divmod(np.unique(np.concatenate((have // MOST * n + links.ravel()[have], a * n + b, b * n + a))), n)
    order = np.lexsort((-_dots(x, a, x, b), a))
    a, b = a[order], b[order]
    size = np.bincount(a, minlength=n)
    place = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
    # of very many, the nearest are looked at
    wide, some = np.full((n, 3 * MOST), -1), place < 3 * MOST
    wide[a[some], place[some]] = b[some]
    out = wide[:, :MOST].copy()
    full = np.flatnonzero(size > MOST)
    if len(full):
        out[full] = _spread(x, full, wide[full], MOST)
    return out


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of rows ``i`` of ``x`` with rows ``j`` of ``y``."""
    step = max(1, PRODUCT // x.shape[1])
    return np.concatenate([np.empty(0, x.dtype), *[np.einsum("id,id->i", x[i[s : s + step]], y[j[s : s + step]]) for s in range(0, len(i), step)]])


def entry_points(vectors: np.ndarray) -> np.ndarray:
    """Numbers of vectors far from one another: each the farthest of a sample from those before it."""
    n = len(vectors)
    some = np.unique(np.linspace(0, max(n - 1, 0), min(n, SAMPLE)).astype(np.int64))[:n]
    x = _unit(vectors[some].astype(np.float32))
    chosen, near = [], np.full(len(some), -np.inf, np.float32)
    for _ in range(min(len(some), int(ENTRIES * n**0.5) + 1)):
        at = int(near.argmin())
        if chosen and near[at] > 1 - 1e-6:
            break  # the rest are copies
        chosen.append(at)
        near = np.maximum(near, x @ x[at])
        near[at] = np.inf
    return some[np.array(chosen, np.int64)]


def build_part(vectors: np.ndarray) -> np.ndarray:
    """The links of a part's vectors: numbers of others, a row for each, -1 for none."""
    x = _unit(vectors.astype(np.float32))
    rows = np.arange(len(x))
    links = np.full((len(x), MOST), -1)
    if len(x) < 2:
        return links
    return _both_ways(x, links, rows, _spread(x, rows, _nearest(x, rows, CANDIDATES, rows), LINKS))


def insert_part(vectors: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The links once the vectors behind those that ``links`` has are linked in."""
    x = _unit(vectors.astype(np.float32))
    fresh = np.arange(len(links), len(x))
    links = np.concatenate((links, np.full((len(fresh), MOST), -1)))
    return _both_ways(x, links, fresh, _spread(x, fresh, _nearest(x, fresh, CANDIDATES, np.arange(len(x))), LINKS))


def search_part(vectors: np.ndarray, links: np.ndarray, alive: np.ndarray, entries: np.ndarray, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the query, number of the vector) of each query's ``k`` nearest found, in no order, and how many were compared."""
    n, beam = len(vectors), max(beam, k)
    x = _unit(vectors.astype(np.float32))
    asked, found, compared = [], [], 0
    for s in range(0, len(q), TOGETHER):
        own = _unit(q[s : s + TOGETHER].astype(np.float32))
        m = len(own)
        seen = np.zeros((m, n), bool)
        seen[:, entries] = True
        like = own @ x[entries].T
        compared += like.size
        # what each query has in view, best first, and whether its links were followed
        width = max(beam + MOST * 4, len(entries))
        view, score, done = np.full((m, width), -1), np.full((m, width), -np.inf, np.float32), np.ones((m, width), bool)
        view[:, : len(entries)], score[:, : len(entries)], done[:, : len(entries)] = entries, like, False
        active = np.arange(m)
        while len(active):
            order = np.argsort(-score[active], axis=1, kind="stable")
            for a in (view, score, done):
                a[active] = np.take_along_axis(a[active], order, 1)
            view[active, beam:], score[active, beam:], done[active, beam:] = -1, -np.inf, True
            # the four best that were not followed yet
            place = np.argsort(done[active, :beam], axis=1, kind="stable")[:, :4]
            open_ = ~np.take_along_axis(done[active, :beam], place, 1)
            active, place, open_ = active[open_.any(1)], place[open_.any(1)], open_[open_.any(1)]
            if not len(active):
                break
            from_ = np.where(open_, np.take_along_axis(view[active], place, 1), -1)
            rows = np.arange(len(active))[:, None]
            mark = done[active]
            mark[rows, place] = True
            done[active] = mark
            to = np.where(from_[:, :, None] >= 0, links[np.maximum(from_, 0)], -1).reshape(len(active), -1)
            to = np.sort(to, axis=1)
            to[:, 1:][to[:, 1:] == to[:, :-1]] = -1
            to = np.where((to >= 0) & ~seen[active[:, None], np.maximum(to, 0)], to, -1)
            i, j = np.nonzero(to >= 0)
            seen[active[i], to[i, j]] = True
            near = np.full(to.shape, -np.inf, np.float32)
            near[i, j] = np.einsum("id,id->i", x[to[i, j]], own[active[i]])
            compared += len(i)
            new = slice(beam, beam + to.shape[1])
            view[active, new], score[active, new], done[active, new] = to, near, to < 0
        ok = (view >= 0) & alive[np.maximum(view, 0)]
        for i in range(m):
            own_found = view[i][ok[i]][:k]
            asked.append(np.full(len(own_found), s + i))
            found.append(own_found)
    return np.concatenate(asked) if asked else np.empty(0, np.int64), np.concatenate(found) if found else np.empty(0, np.int64), compared


class GraphIndex:
    """The graph of the rows (id, vector) of one table, in ``root``.

    Vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor rows without an id. Vectors of
    different lengths are in parts of their own. ``parts`` is fixed when the index is made; see ``build``.
    """

    def __init__(self, spark: SparkSession, root: str, id_type: str = "long"):
        self.spark, self.store, self.id_type = spark, Store(spark, root), id_type
        self.schema = _STATE.format(id_type)

    def _rows(self, rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        v = F.col(vector_col).cast("array<float>")
        finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        some = rows.select(F.col(id_col).cast(self.id_type).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite & F.exists(v, lambda c: c != 0))
        return some

    def _parted(self, rows: DataFrame, parts: int) -> DataFrame:
        return rows.withColumn("part", F.concat_ws("-", F.size("v").cast("string"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("string")))

    def _parts(self) -> int:
        return int(self.store.model_name(COLLECTION).split(":")[1])

    def build(self, rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", part: int = PART) -> None:
        """Make the index anew from ``rows``, in parts of about ``part`` vectors. Of rows with one id any one counts."""
        some = materialize(self._rows(rows, id_col, vector_col).dropDuplicates(["id"]))
        parts = max(1, -(-some.count() // part))
        self.store.delete_collection(COLLECTION)
        self.store.open(COLLECTION, self.schema, model_name=f"parts:{parts}", key="part", buckets=min(parts, 1_024))
        self.store.replace(COLLECTION, self._parted(some, parts).groupBy("part").applyInArrow(_made, self.schema))

    def change(self, rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", delete: DataFrame | None = None) -> None:
        """Put in ``rows``, those with known ids in place of what is there, and take out the ids of ``delete`` (id)."""
        fresh = self._parted(self._rows(rows, id_col, vector_col).dropDuplicates(["id"]), self._parts()).withColumn("gone", F.lit(False))
        state = self.store.table(COLLECTION)
        # a known id may stand in a part of another length
        lengths = [r.dimension for r in state.select("dimension").distinct().collect()]
        out = rows.select(F.col(id_col).cast(self.id_type).alias("id"))
        if delete is not None:
            out = out.unionByName(delete.select(F.col("id").cast(self.id_type).alias("id")))
        number = F.pmod(F.xxhash64("id"), F.lit(self._parts())).cast("string")
        gone = out.where("id IS NOT NULL").distinct().withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).select(
            "id", F.lit(None).cast("array<float>").alias("v"), F.concat_ws("-", F.col("length").cast("string"), number).alias("part"), F.lit(True).alias("gone"))
        changed = materialize(fresh.unionByName(gone))

        def merge(old: pa.Table, new: pa.Table) -> pa.Table:
            dead = set(new.filter(new["gone"])["id"].to_pylist())
            new = new.filter(pa.compute.invert(new["gone"])).sort_by("id")
            if not old.num_rows and not new.num_rows:
                return _table("", pa.array([], new["id"].type), np.empty((0, 1), np.float32), np.empty((0, MOST)), np.empty(0, bool)).slice(0, 0)
            ids, vectors, links, alive = [], np.empty((0, 0), np.float32), np.empty((0, MOST), np.int64), np.empty(0, bool)
            if old.num_rows:
                ids, vectors, links, alive, _ = _arrays(old, 0)
                ids, alive = ids.to_pylist(), alive & np.array([i not in dead for i in ids.to_pylist()], bool)
            added = new["v"].combine_chunks().flatten().to_numpy().reshape(new.num_rows, -1) if new.num_rows else np.empty((0, vectors.shape[1]), np.float32)
            ids += new["id"].to_pylist()
            vectors = np.concatenate((vectors, added)) if len(vectors) else added
            alive = np.concatenate((alive, np.ones(len(added), bool)))
            if alive.mean() < 1 - DEAD:
                ids, vectors, alive = [i for i, a in zip(ids, alive, strict=True) if a], vectors[alive], alive[alive]
                links = build_part(vectors)
            elif len(added):
                links = insert_part(vectors, links)
            return _table((old if old.num_rows else new)["part"][0].as_py(), pa.array(ids, new["id"].type), vectors, links, alive)

        touched = changed.select("part").distinct()
        fresh_parts = state.join(touched, "part", "left_semi").groupBy("part").cogroup(changed.groupBy("part")).applyInArrow(merge, self.schema)
        self.store.add(COLLECTION, materialize(fresh_parts))

    def count(self) -> int:
        return self.store.table(COLLECTION).select(F.size(F.filter("alive", lambda a: a)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]

    def search(self, queries: DataFrame, k: int, beam: int = BEAM, version: int | None = None) -> DataFrame:
        """(query_id, rank, id, distance): the ``k`` nearest found of each of ``queries`` (query_id, embedding) by cosine distance,
        to 12 decimals; ties go to the smaller id. More queries than ``QUERIES_AT_ONCE`` are searched in turns, each written."""
        parts = self.store.table(COLLECTION, version)
        kind = queries.schema["query_id"].dataType.simpleString()
        asked = self._rows_of(queries)
        turns = max(1, -(-asked.count() // QUERIES_AT_ONCE))
        found = None
        for turn in range(turns):
            some = asked if turns == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
            part = self._turn(parts, self.spark.sparkContext.broadcast(some.toArrow().combine_chunks()), kind, k, beam)
            part = materialize(part) if turns > 1 else part
            found = part if found is None else found.unionByName(part)
        return found

    def _rows_of(self, queries: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<float>")
        ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
        return queries.select("query_id", v.alias("v")).where("query_id IS NOT NULL AND v IS NOT NULL").where(ok)

    def _turn(self, parts: DataFrame, shared, kind: str, k: int, beam: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            long = np.array([len(v) for v in asked["v"]])
            for b in batches:
                for r in range(b.num_rows):
                    ids, vectors, links, alive, entries = _arrays(b, r)
                    own = np.flatnonzero(long == vectors.shape[1])
                    if not len(own) or not len(vectors):
                        continue
                    some = asked.take(pa.array(own))
                    q = some["v"].combine_chunks().flatten().to_numpy().reshape(len(own), -1)
                    i, j, _ = search_part(vectors, links, alive, entries, q, k, beam)
                    distance = np.round(1 - _dots(_unit(q.astype(np.float64)), i, _unit(vectors.astype(np.float64)), j), 12)
                    yield pa.RecordBatch.from_arrays([some["query_id"].combine_chunks().take(pa.array(i)), ids.take(pa.array(j)), pa.array(distance)], ["query_id", "id", "distance"])

        found = parts.select("ids", "vectors", "links", "alive", "entries", "dimension").mapInArrow(run, f"query_id {kind}, id {self.id_type}, distance double")
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _made(rows: pa.Table) -> pa.Table:
    """The graph of one part's rows (id, v, part)."""
    rows = rows.sort_by("id")
    vectors = rows["v"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return _table(rows["part"][0].as_py(), rows["id"].combine_chunks(), vectors, build_part(vectors), np.ones(len(vectors), bool))


def _table(part: str, ids: pa.Array, vectors: np.ndarray, links: np.ndarray, alive: np.ndarray) -> pa.Table:
    columns = ((ids, ids.type), (pa.array(vectors.ravel()), pa.float32()), (pa.array(links.ravel()), pa.int32()), (pa.array(alive), pa.bool_()), (pa.array(entry_points(vectors)), pa.int32()))
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.cast(t)) for c, t in columns]
    return pa.table([pa.array([part]), pa.array([vectors.shape[1]], pa.int32()), *lists], ["part", "dimension", "ids", "vectors", "links", "alive", "entries"])


def _arrays(table: pa.Table | pa.RecordBatch, row: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, links, alive, entries) of one part."""
    ids, vectors, links, alive, entries = (table[c][row].values for c in ("ids", "vectors", "links", "alive", "entries"))
    return ids, vectors.to_numpy().reshape(len(ids), table["dimension"][row].as_py()), links.to_numpy().astype(np.int64).reshape(-1, MOST), alive.to_numpy(zero_copy_only=False), entries.to_numpy().astype(np.int64)
