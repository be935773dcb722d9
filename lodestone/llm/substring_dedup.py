"""Substring deduplication with a log-structured fingerprint index.

A document's fingerprints are the hashes of the 5-word runs that are smallest in some 13-word window, so equal
windows always share one. The index keeps, for every fingerprint, the smallest and the largest hash of a text
it was seen in, as immutable bucketed runs sorted by fingerprint. A new batch becomes a run; it is
merge-joined with the earlier runs, and fingerprints seen in different texts are reported; when enough runs
have gathered they are merged into one. Beside them stands which text has which fingerprints, so that only texts
with a reported one are read again. Around reported fingerprints whole windows are compared, by a hash of
the window and one of cryptographic digests of its words, and each window's first document decides what later ones
lose.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, freeing_shuffles, give_up, materialize, pieces, read_table, shared_dir, small_batches, unused
from .words import Words, mix, word_blocks

WINDOW = 13
GRAM = 5
#: Runs of one level that are merged into one of the next.
FAN_OUT = 2
#: Batches a table is taken in: the last one meets the merged run of those before it.
BATCHES = 3
#: Manifests are numbered, so that one is always there.
MANIFEST = re.compile(r"manifest-(\d+)\.json")
#: Word digests that a task remembers, about.
MOST_DIGESTS = 200_000


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of ``width`` values from each place on; shorter at the end."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = pick(out[:-step], out[step:]) if len(out) > step else out[:-step]
        have += step
    return out


def selected(words: Words, gram_hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Which run hashes are the smallest of some window (all of equal ones), and each window's smallest."""
    n = len(gram_hashes)
    if not n:
        return np.zeros(0, bool), gram_hashes
    width = window - gram + 1
    room = words.room(window)
    least = _slide(gram_hashes, width, np.minimum)
    from_window = np.where(room, least, np.uint64(0))
    # place p lies in the windows from p - width + 1 to p
    best = _slide(np.concatenate((np.zeros(width - 1, np.uint64), from_window)), width, np.maximum)[:n]
    return (best == gram_hashes) & (best > 0), least


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes that stand for the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"))


def fingerprints(keyed: DataFrame) -> DataFrame:
    """(fp, t1, t2): the fingerprints of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in batches:
            t1, t2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            for a, _, w in word_blocks(b.column(0)):
                h = w.runs(w.hashes(), GRAM)
                at = np.flatnonzero(selected(w, h)[0])
                row = w.owner()[at] + a
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(t1[row]), pa.array(t2[row])], ["fp", "t1", "t2"])

    return keyed.select("text", "t1", "t2").mapInArrow(run, "fp long, t1 long, t2 long")


class FingerprintIndex:
    """Sorted immutable runs of (fp, least, most), bucketed alike so that runs join without a shuffle; for every
    batch (fp, t1), which text has which fingerprints; and (t1, t2, first_id), the smallest id of each text.

    All that and a manifest that lists it are in ``folder``. An index that stands there is opened again, in
    another session too; ``drop`` gives it up. Without a folder it is one of the application's own. One writer
    at a time: the next manifest is written once the new runs are, and the last one goes after that.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_out: int = FAN_OUT):
        self.spark, self.fan_out, self.folder = spark, fan_out, folder or shared_dir(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # (level, table), oldest first
        self.written: list[str] = []
        self.postings: list[str] = []
        self.texts: list[str] = []
        self.number = 0
        fs, path = self._path("")
        found = [int(m[1]) for f in (fs.listStatus(path) if fs.exists(path) else []) if (m := MANIFEST.fullmatch(f.getPath().getName()))]
        if found:
            self.number = max(found)
            kept = json.loads("".join(r.value for r in spark.read.text(self._path(f"manifest-{self.number}.json")[1].toString()).collect()))
            self.buckets, self.runs, self.postings, self.texts = kept["buckets"], [(level, name) for level, name in kept["runs"]], kept["postings"], kept["texts"]
            for _, name in self.runs:
                self.written.append(name)
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, least BIGINT, most BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")

    def _path(self, name: str):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _write(self, rows: DataFrame) -> str:
        name = f"lodestone_run_{uuid.uuid4().hex}"
        self.written.append(name)
        with freeing_shuffles(self.spark), small_batches(self.spark):
            rows.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _write_beside(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}_{uuid.uuid4().hex}"
        with freeing_shuffles(self.spark), small_batches(self.spark):
            rows.write.parquet(f"{self.folder}/{name}")
        return name

    def _list(self) -> None:
        fs, fresh = self._path(f"new-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": self.runs, "postings": self.postings, "texts": self.texts}).encode()))
        out.close()
        self.number += 1
        if not fs.rename(fresh, self._path(f"manifest-{self.number}.json")[1]):
            raise RuntimeError(f"another writer has added to {self.folder}")
        fs.delete(self._path(f"manifest-{self.number - 1}.json")[1], False)

    def add(self, found: DataFrame, texts: DataFrame | None = None) -> list[DataFrame]:
        """Take in a batch's (fp, t1) and its (t1, t2, first_id); returns tables of the fps that are now known in
        different texts."""
        self.postings.append(self._write_beside(found.select("fp", "t1"), "postings"))
        if texts is not None:
            self.texts.append(self._write_beside(texts.select("t1", "t2", "first_id"), "texts"))
        found = self._beside(self.postings[-1:], "fp long, t1 long")
        run = self._write(found.groupBy("fp").agg(F.min("t1").alias("least"), F.max("t1").alias("most")))
        new = self.spark.table(run)
        shared = [new.where("least < most").select("fp")]
        for _, name in self.runs:
            old = self.spark.table(name).select("fp", F.col("least").alias("old_least"), F.col("most").alias("old_most"))
            shared.append(new.join(old.hint("merge"), "fp").where("least(least, old_least) < greatest(most, old_most)").select("fp"))
        self.runs.append((0, run))
        self._compact()
        self._list()
        return shared

    def _beside(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def near(self, known: DataFrame) -> DataFrame:
        """(t1, fps): the texts that have fingerprints of ``known`` (fp), and which."""
        return self._beside(self.postings, "fp long, t1 long").join(known, "fp").groupBy("t1").agg(F.collect_set("fp").alias("fps"))

    def known_texts(self) -> DataFrame:
        """(t1, t2, first_id) of all texts taken in."""
        return self._beside(self.texts, "t1 long, t2 long, first_id long").groupBy("t1", "t2").agg(F.min("first_id").alias("first_id"))

    def drop(self) -> None:
        """Give up the index, merged runs included."""
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs, self.written, self.postings, self.texts = [], [], [], []
        fs, path = self._path("")
        fs.delete(path, True)

    def _compact(self) -> None:
        """Merge the runs of a level once there are ``fan_out``; the merged ones stay for readers under way."""
        level = 0
        while len(own := [t for l, t in self.runs if l == level]) >= self.fan_out:
            merged = self.spark.table(own[0])
            for t in own[1:]:
                other = self.spark.table(t).select("fp", F.col("least").alias("l"), F.col("most").alias("m"))
                merged = merged.join(other.hint("merge"), "fp", "full").select("fp", F.least("least", "l").alias("least"), F.greatest("most", "m").alias("most"))
            self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, self._write(merged))]
            level += 1


def _batches(keyed: DataFrame, n: int) -> list[DataFrame]:
    """``n`` batches in order of the id; rows without an id, which no other document loses words to, go nowhere."""
    if n < 2:
        return [keyed.where(F.col("doc_id").isNotNull())]
    marks = keyed.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000).alias("m")).head().m
    if not marks:
        return [keyed.where(F.col("doc_id").isNotNull())]
    marks = sorted(set(marks))
    lows, highs = [None, *marks], [*marks, None]
    return [keyed.where((F.lit(True) if lo is None else F.col("doc_id") > lo) & (F.lit(True) if hi is None else F.col("doc_id") <= hi) & F.col("doc_id").isNotNull())
            for lo, hi in zip(lows, highs, strict=True)]


class _Digests(dict):
    """64 bits of a cryptographic digest of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_DIGESTS:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found

    def windows(self, w: Words, i: int) -> np.ndarray:
        """A hash of the digests of each window's words in text ``i``."""
        words = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split()  # at the same bytes
        each, n = np.fromiter(map(self.__getitem__, words), np.uint64, len(words)), len(words) - WINDOW + 1
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x9FB21C651E98DF25) + each[k : n + k]
        return mix(h).view(np.int64)


_PAIR = np.dtype([("h", "<i8"), ("v", "<i8")])


def _pairs(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), _PAIR)
    out["h"], out["v"] = h, v
    return out


def _texts(keyed: DataFrame) -> DataFrame:
    """(t1, t2, first_id): each text with the smallest id that has it."""
    return keyed.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"))


def repeated_windows(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """What each text of ``docs`` loses, see ``_lost``; the fingerprints are taken in by ``batches``."""
    keyed = _keyed(docs)
    index = FingerprintIndex(docs.sparkSession)
    try:
        known = _known([s for part in _batches(keyed, batches) for s in index.add(fingerprints(part).select("fp", "t1"))])
        near = materialize(index.near(known))
    finally:
        index.drop()
    discard(known)
    return _lost(keyed, materialize(_texts(keyed)), near)


def _known(shared: list[DataFrame]) -> DataFrame:
    known = shared[0]
    for s in shared[1:]:
        known = known.unionByName(s)
    return materialize(known.distinct())


def _lost(keyed: DataFrame, texts: DataFrame, near: DataFrame) -> DataFrame:
    """One row for each of ``texts``: (t1, t2, first_id, lost).

    ``first_id`` is the smallest id with that text; ``lost`` holds the hashes of those of its windows that
    also start in a document with a smaller id (null: none). Copies of a text lose what it has, all of it.
    ``keyed`` has the texts that ``near`` has, which says what fingerprints they share; ``texts`` and ``near`` are deleted.
    """

    def windows(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        digests = _Digests()
        for b in pieces(batches_, 200):
            first, t1, t2 = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            for a, z, w in word_blocks(b.column(0)):
                word = w.hashes()
                h, room, (_, least) = w.runs(word, WINDOW).view(np.int64), w.room(WINDOW), selected(w, w.runs(word, GRAM))
                found = []
                for i in range(a, z):
                    s, e = w.first[i - a], w.first[i - a + 1]
                    at = np.flatnonzero(np.isin(least[s:e], b.column(4)[i].values.to_numpy().view(np.uint64)) & room[s:e])
                    if len(at):
                        found.append((h[s + at], digests.windows(w, i - a)[at], *(np.full(len(at), c[i]) for c in (first, t1, t2))))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["h", "v", "id", "t1", "t2"])

    # One row of each text: that of the smallest id (equal rows give equal windows).
    sources = near.join(texts, "t1").where("first_id is not null")
    candidates = (keyed.join(sources, ["t1", "t2"]).where("doc_id = first_id").select("text", "first_id", "t1", "t2", "fps")
                  .mapInArrow(windows, "h long, v long, id long, t1 long, t2 long"))
    candidates = materialize(candidates)
    firsts = materialize(candidates.groupBy("h", "v").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h", "v", "low"))
    lost = (candidates.join(firsts, ["h", "v"]).where("low < id")
            .groupBy("t1", "t2").agg(F.collect_set(F.struct("h", "v")).alias("lost")))
    found = materialize(texts.join(lost, ["t1", "t2"], "left"))
    discard(near, texts, candidates, firsts)
    return found


def _judged(docs: DataFrame, found: DataFrame, schema: str | StructType, make) -> DataFrame:
    """``make(batch, rows)`` for every batch of ``docs`` with what its texts lose by ``found``; ``rows`` has (words, number of
    the text in them, which of its words stay) for each row."""
    own_id, text, t1, t2, first_id, lost_ = unused(docs, "own_id", "words_of", "t1", "t2", "first_id", "lost")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        digests = _Digests()
        for b in pieces(batches_, 200):
            for a, z, w in word_blocks(b.column(text)):
                rows, h = [], None
                for i in range(a, z):
                    s, e = w.first[i - a], w.first[i - a + 1]
                    own, first, lost = b.column(own_id)[i].as_py(), b.column(first_id)[i].as_py(), b.column(lost_)[i]
                    keep = np.ones(e - s, bool)
                    rows.append((w, i - a, keep))
                    if own is None or first is None or e - s < WINDOW:
                        continue
                    if own > first:
                        keep[:] = False
                    elif lost.is_valid:
                        if h is None:
                            h = w.runs(w.hashes(), WINDOW).view(np.int64)
                        values, n = lost.values, e - s - WINDOW + 1
                        at = np.flatnonzero(np.isin(_pairs(h[s : s + n], digests.windows(w, i - a)), _pairs(values.field(0).to_numpy(), values.field(1).to_numpy())))
                        depth = np.zeros(e - s + 1, np.int64)
                        depth[at] += 1
                        np.add.at(depth, at + WINDOW, -1)
                        keep[:] = np.cumsum(depth)[: e - s] == 0
                yield make(b.slice(a, z - a), rows)

    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), text: F.coalesce(F.col("text"), F.lit(""))})
    keyed = keyed.withColumns({t1: F.xxhash64(text), t2: F.xxhash64(F.lit("second"), F.col(text))})
    return keyed.join(found.toDF(t1, t2, first_id, lost_), [t1, t2], "left").mapInArrow(run, schema)


def _digests(docs: DataFrame, found: DataFrame) -> DataFrame:
    def make(b: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        counts = [pa.array([n(keep) for _, _, keep in rows], pa.int64()) for n in (len, lambda keep: len(keep) - int(keep.sum()))]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array([hashlib.sha256(w.text(k, keep)).hexdigest() for w, k, keep in rows], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _judged(docs.select("doc_id", "text"), found, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", make)


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than space and tab to carriage return. A word goes if a window of 13
    words that covers it also starts in a document with a smaller id; windows are judged on the texts as they
    came in. A null text has no words. A null id is neither smaller nor larger than another: its row keeps
    all its words and takes none from others. Rows with one id are one document; ids must be whole numbers, or
    strings of them. An empty table gives no rows; other columns are ignored.
    """
    return _digests(docs, repeated_windows(docs, batches))


def remove_repeats_of_batch(batch: DataFrame, history: DataFrame, index: FingerprintIndex) -> DataFrame:
    """The same for the rows of ``batch`` alone, next to ``history``, whose fingerprints ``index`` holds already.

    The batch is added to the index. Of ``history`` the rows with ids that the index names are read, those whose texts
    have a fingerprint that is known in different texts and that the batch has too; nothing else of it is hashed.
    Words that history would lose to smaller ids of the batch are not looked for.
    """
    keyed = _keyed(batch)
    earlier = materialize(index.known_texts())
    known = _known(index.add(fingerprints(keyed.where(F.col("doc_id").isNotNull())).select("fp", "t1"), _texts(keyed.where(F.col("doc_id").isNotNull()))))
    near = materialize(index.near(known))
    discard(known)
    both = keyed.unionByName(_history_rows(history, earlier, near))
    texts = materialize(_texts(keyed).unionByName(earlier).groupBy("t1", "t2").agg(F.min("first_id").alias("first_id")))
    found = _lost(both, texts, near)
    discard(earlier)
    return _digests(batch, found)


def _history_rows(history: DataFrame, earlier: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of ``history``, keyed, that stand for ``earlier`` texts which ``near`` has."""
    ids = earlier.join(near.select("t1"), "t1", "left_semi").select(F.col("first_id").alias("doc_id")).distinct()
    return _keyed(history.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"))


def without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with the repeated words out of ``text``; see
    ``remove_repeats`` for nulls, repeated ids and ties.

    A text that loses nothing stays as it is, others become their kept words joined by one space, and
    ``n_chars`` follows. A document that loses all its words stays, with an empty text. Other columns stay.
    """

    def make(b: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        own = b.select(columns)
        shorter = pa.array([not keep.all() for _, _, keep in rows])
        texts = [w.text(k, keep).decode() for w, k, keep in rows if not keep.all()]
        for name, new in (("text", texts), ("n_chars", [len(t) for t in texts])):
            if texts and name in columns:
                at = columns.index(name)
                own = own.set_column(at, own.schema.field(at), pc.replace_with_mask(own.column(at), shorter, pa.array(new, own.schema.field(at).type)))
        return own

    columns = docs.columns
    return _judged(docs, repeated_windows(docs, batches), docs.schema, make)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; see ``remove_repeats``."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM d)),
firsts AS (SELECT win, min(doc_id) AS low FROM windows GROUP BY win),
hits AS (SELECT doc_id, p FROM windows JOIN firsts USING (win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM hits, range(13) r(k)),
lost AS (SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, words, CASE WHEN places IS NULL THEN words ELSE (SELECT list(w ORDER BY i) FROM (SELECT unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i) WHERE NOT list_contains(places, i)) END AS left_ FROM d LEFT JOIN lost USING (doc_id))
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(len(left_), 0) AS n_removed, sha256(coalesce(array_to_string(left_, ' '), '')) AS kept_sha256 FROM kept
"""
