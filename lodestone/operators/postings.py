"""Posting lists: which texts have a word, so that queries meet them by an equality join.

A list is cut into blocks of neighbouring text numbers. A block says its first and last number and how many there are, and has
the gaps between them, which are small where a word is frequent; so no row grows with the corpus, and a reader of a range of
texts skips blocks. Two kinds of words are listed: as they stand, for identifiers, and of the lower-cased text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ident

#: Text numbers of one block.
BLOCK = 1 << 16
#: Asked words up to this many are broadcast; more are joined by shuffling.
BROADCAST_WORDS = 100_000


def words_of_texts(texts: DataFrame) -> DataFrame:
    """(text_id, lower, word): the distinct words of ``texts`` (text_id, content), as they stand and lower-cased.

    Texts are taken apart once for each kind. Null texts have no words; repeated ids are one text.
    """
    words = F.array(F.struct(F.lit(False).alias("lower"), F.array_distinct(ident.words_of(F.col("content"))).alias("words")),
                    F.struct(F.lit(True).alias("lower"), F.array_distinct(ident.words_of(F.lower("content"))).alias("words")))
    each = texts.select("text_id", F.explode(words).alias("w")).select("text_id", "w.lower", F.explode("w.words").alias("word"))
    return each


#: A text with this letter is lower-cased whole, as what it becomes depends on the letters around; any other word by word.
SIGMA = "\u03a3"
#: Whether words of a text are listed both as they stand and lower-cased, only as they stand, or as they are for lower case.
BOTH, OWN, LOWER = 0, 1, 2
#: Words of neighbouring texts that are grouped at once.
TOGETHER = 2_000_000
#: Texts a task, about, whose short lists are sorted and merged together, if the session's shuffles have too few tasks for that.
TEXTS = 8_192


def build(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lower, word, block, first, last, n, gaps) from ``texts`` (text_id, content), text_id a whole number.

    ``gaps`` begins with 0 and goes on with the distance of each number to the one before. Texts without an id are left out.
    Texts are taken apart once. What is shuffled are short lists, of each word in neighbouring texts; the lists of lower-cased
    words are unions of them, so words meet by their lower case.
    """
    whole = F.array(F.struct(F.lit(OWN).alias("kind"), ident.words_of(F.col("content")).alias("words")), F.struct(F.lit(LOWER).alias("kind"), ident.words_of(F.lower("content")).alias("words")))
    apart = F.when(F.contains("content", F.lit(SIGMA)), whole).otherwise(F.array(F.struct(F.lit(BOTH).alias("kind"), ident.words_of(F.col("content")).alias("words"))))
    each = texts.where("text_id IS NOT NULL AND content IS NOT NULL").select(F.col("text_id").cast("long").alias("text_id"), F.explode(apart).alias("w")).select("text_id", "w.kind", "w.words")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.list_value_length(b["words"]).to_numpy())
            cut = np.unique(np.r_[0, np.searchsorted(ends, np.arange(TOGETHER, ends[-1] if len(ends) else 0, TOGETHER), side="right"), b.num_rows])
            for s, e in itertools.pairwise(cut.tolist()):
                yield from _near(b.slice(s, e - s), block)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _whole(batches, "key", "block"):
            yield from _merged(some, block)

    short = each.mapInArrow(near, "kind int, word string, block long, ids array<long>")
    key = F.when(F.col("kind") == LOWER, F.col("word")).otherwise(F.lower("word"))
    short = short.withColumn("key", key)
    tasks = -(-texts.count() // TEXTS)
    few = tasks <= int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = (short.repartition("key") if few else short.repartition(tasks, "key")).sortWithinPartitions("key", "block")
    return short.mapInArrow(lists, "lower boolean, word string, block long, first long, last long, n long, gaps array<long>")


def _near(texts: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
    """(kind, word, block, ids) of the words of ``texts`` (text_id, kind, words)."""
    words = texts["words"].flatten().dictionary_encode()
    if not len(words):
        return
    ids, rank = np.unique(texts["text_id"].to_numpy(), return_inverse=True)
    size = pc.list_value_length(texts["words"]).to_numpy()
    of = texts["kind"].to_numpy().astype(np.int64)
    pairs = np.unique((np.repeat(of, size) * len(words.dictionary) + words.indices.to_numpy()) * len(ids) + np.repeat(rank, size))
    named, ids = pairs // len(ids), ids[pairs % len(ids)]
    blocks = ids // block
    start = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (blocks[1:] != blocks[:-1])])
    kind, word = np.divmod(named[start], len(words.dictionary))
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), words.dictionary.take(pa.array(word)), pa.array(blocks[start]), _cut(start, ids)], ["kind", "word", "block", "ids"])


def _cut(start: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[start, len(values)], pa.int32()), pa.array(values))


def _merged(rows: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
    """The lists of some whole groups of short ones (kind, word, block, ids, key), sorted by key and block."""
    rows = rows.combine_chunks()
    blocks, kind, ids = rows["block"].to_numpy(), rows["kind"].to_numpy(), rows["ids"].combine_chunks()
    size, places = pc.list_value_length(ids).to_numpy(), ids.flatten().to_numpy()
    group = np.cumsum(_changes(rows, "key", "block")) - 1
    words = rows["word"].combine_chunks().dictionary_encode()
    for lower, some, of, name in ((True, kind != OWN, group, rows["key"].combine_chunks()), (False, kind != LOWER, group * len(words.dictionary) + words.indices.to_numpy(), rows["word"].combine_chunks())):
        if not some.any():
            continue
        _, one, number = np.unique(of[some], return_index=True, return_inverse=True)
        one = np.flatnonzero(some)[one]
        local = places[np.repeat(some, size)] - np.repeat(blocks[some] * block, size[some])
        pairs = np.unique(np.repeat(number, size[some]) * block + local)
        number, local = np.divmod(pairs, block)
        start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        n = np.diff(np.r_[start, len(pairs)])
        gaps = np.diff(local, prepend=0)
        gaps[start] = 0
        base = blocks[one] * block
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(one), lower)), name.take(pa.array(one)), pa.array(blocks[one]), pa.array(base + local[start]), pa.array(base + local[start + n - 1]), pa.array(n), _cut(start, gaps)],
            ["lower", "word", "block", "first", "last", "n", "gaps"])


def write(postings: DataFrame, path: str) -> None:
    """Write lists where they are made, each file in the order of its words, so that a reader of a few words skips the pages
    without them. A word's lists of all cases are in one file, if ``build`` made them; nothing is sampled or dealt out again."""
    postings.sortWithinPartitions("lower", "word", "block").write.parquet(path)


def texts_with(postings: DataFrame, asked: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """``asked`` (lower, word, ...) with a row for each text_id that has the word; of texts from ``low`` to ``high`` only, if
    these are given. A word that is asked several times meets its list each time; one that no text has meets nothing."""
    lists = postings.select("lower", "word", "first", "last", "gaps")
    if low is not None:
        lists = lists.where(F.col("last") >= low)
    if high is not None:
        lists = lists.where(F.col("first") <= high)
    words = asked.select("lower", "word").distinct()
    few = words.count() <= BROADCAST_WORDS
    lists = lists.join(F.broadcast(words) if few else words, ["lower", "word"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, size = _numbers(b.column("first").to_numpy(), b.column("gaps"))
            row = pa.array(np.repeat(np.arange(b.num_rows), size))
            yield pa.RecordBatch.from_arrays([b.column("lower").take(row), b.column("word").take(row), pa.array(ids)], ["lower", "word", "text_id"])

    found = lists.mapInArrow(run, "lower boolean, word string, text_id long")
    if low is not None:
        found = found.where(F.col("text_id") >= low)
    if high is not None:
        found = found.where(F.col("text_id") <= high)
    return found.join(F.broadcast(asked) if few else asked, ["lower", "word"])


def asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, lower, word): what ``queries`` (query_id, query) look for: identifiers as they stand, and significant
    words in lower case."""
    names, words = ident.identifiers(F.col("query")), ident.significant_words(F.col("query"))
    both = F.array(F.struct(F.lit(False).alias("lower"), names.alias("words")), F.struct(F.lit(True).alias("lower"), words.alias("words")))
    return queries.select("query_id", F.explode(both).alias("w")).select("query_id", "w.lower", F.explode("w.words").alias("word"))


def score(found: DataFrame, queries: DataFrame, base: float = ident.BASE_BOOST) -> DataFrame:
    """(query_id, text_id, matches, has_word, boost) of the pairs in ``found`` (query_id, text_id, lower, word): how many of the
    query's identifiers a text has, whether it has a significant word, and the factor that lifts it; any other pair has
    none and the factor one. A text's rows of one query meet in one place: at most one for each of the query's words."""
    matches = F.count(F.when(~F.col("lower"), F.lit(1)))
    pairs = found.groupBy("query_id", "text_id").agg(matches.alias("matches"), F.coalesce(F.bool_or("lower"), F.lit(False)).alias("has_word"))
    return _lifted(pairs, queries, base)


def _lifted(pairs: DataFrame, queries: DataFrame, base: float) -> DataFrame:
    named = queries.select("query_id", (F.size(ident.identifiers(F.col("query"))) > 0).alias("named"))
    return pairs.join(named, "query_id").select("query_id", "text_id", "matches", "has_word", boost(F.col("named"), F.col("matches"), F.col("has_word"), base).alias("boost"))


def score_lists(postings: DataFrame, queries: DataFrame, base: float = ident.BASE_BOOST) -> DataFrame:
    """As ``score`` of what ``texts_with`` finds, without a row for each word of a pair and without grouping pairs: the lists of
    one block meet, each with the queries that ask for it, and are counted there. So what is shuffled are lists, and a task
    holds a block of texts at a time, however many pairs there are."""
    asked = asked_words(queries).groupBy("lower", "word").agg(F.collect_set("query_id").alias("queries"))
    few = asked.count() <= BROADCAST_WORDS
    lists = postings.select("lower", "word", "block", "first", "gaps").join(F.broadcast(asked) if few else asked, ["lower", "word"])
    lists = lists.select("block", "lower", "first", "gaps", "queries").repartition("block").sortWithinPartitions("block")
    kind = queries.schema["query_id"].dataType.simpleString()
    return _lifted(lists.mapInArrow(_counted, f"query_id {kind}, text_id long, matches long, has_word boolean"), queries, base)


def _whole(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """Rows sorted by ``by``, cut where these columns change; in each table all rows of some groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.flatnonzero(_changes(b, *by))[1:]
        if held and any(b[c][0] != held[0][c][0] for c in by):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, b.slice(0, new[-1])])
            held = []
        held.append(b.slice(new[-1] if len(new) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _changes(rows: pa.RecordBatch | pa.Table, *by: str) -> np.ndarray:
    """Where a row has other values in ``by`` than the row before; the first one has."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for c in by:
        out[1:] |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
    return out


def _numbers(first: np.ndarray, gaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists one behind the other, and how many each list has."""
    size = pc.list_value_length(gaps).to_numpy()
    out = gaps.flatten().to_numpy().copy()
    start = np.cumsum(size) - size
    # one running sum: each list's first place makes up for where the last one ended
    total = np.add.reduceat(out, start)
    out[start] = first - np.r_[0, (first + total)[:-1]]
    return np.cumsum(out), size


#: Pairs that are handed on together.
PAIRS = 1 << 17


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, text_id, matches, has_word) of lists (block, lower, first, gaps, queries), sorted by block."""
    for some in _whole(batches, "block"):
        for s, e in itertools.pairwise([*np.flatnonzero(_changes(some, "block")), some.num_rows]):
            yield from _counted_block(some.slice(s, e - s).combine_chunks())


def _counted_block(lists: pa.Table) -> Iterator[pa.RecordBatch]:
    first, gaps, asking = (lists[c].combine_chunks() for c in ("first", "gaps", "queries"))
    ids, size = _numbers(first.to_numpy(), gaps)
    texts, place = np.unique(ids, return_inverse=True)
    start = np.cumsum(size) - size
    lower = lists["lower"].to_numpy()
    names = asking.flatten().dictionary_encode()
    query, row = names.indices.to_numpy(), np.repeat(np.arange(len(size)), pc.list_value_length(asking).to_numpy())
    order = np.argsort(query, kind="stable")
    row, bounds = row[order], np.cumsum(np.bincount(query, minlength=len(names.dictionary)))
    held, n = [], 0
    for q, (s, e) in enumerate(itertools.pairwise([0, *bounds])):
        of = lambda rows: np.concatenate([np.empty(0, np.int64), *[place[start[r] : start[r] + size[r]] for r in rows]])
        own = row[s:e]
        named, worded = of(own[~lower[own]]), of(own[lower[own]])
        met = np.unique(np.concatenate((named, worded)))
        at = np.searchsorted(met, named)
        has = np.zeros(len(met), bool)
        has[np.searchsorted(met, worded)] = True
        held.append((np.full(len(met), q), texts[met], np.bincount(at, minlength=len(met)), has))
        n += len(met)
        if n >= PAIRS or q == len(bounds) - 1:
            who, *rest = map(np.concatenate, zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(who)), *map(pa.array, rest)], ["query_id", "text_id", "matches", "has_word"])
            held, n = [], 0


def boost(named: Column, matches: Column, has_word: Column, base: float = ident.BASE_BOOST) -> Column:
    """The factor of ``identifiers.boost`` from counts."""
    return F.when(named, F.when(matches == 0, 1.0).otherwise(base * (1 + (matches - 1) * 0.5))).when(has_word, ident.WORD_BOOST).otherwise(1.0)


def scan(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """As ``texts_with``, from the texts themselves: for a set of queries that is asked once, in one pass without lists."""
    few = F.broadcast(asked) if asked.count() <= BROADCAST_WORDS else asked
    return words_of_texts(texts).join(few, ["lower", "word"])
