"""Language identification with language-bitmask n-gram filters.

The frequent character n-grams of each learned language are put into one Bloom filter stored across
languages: a slot holds a bitmask, one bit a language, so that one probe answers for all of them and the AND
of a gram's slots is the set of languages that have it. Per-language popcounts over a text, less the
false positives that the filter's fill predicts, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_up, materialize, pieces, read_table, unused

UNKNOWN = "und"
ORDERS = (3, 4)
#: Documents of each language that the model is fitted on, about: those with the smallest hashes of their id.
TRAIN_DOCS = 2_000
#: Share of a language's n-grams from which an n-gram is put into its filter; at most 1 / SHARE are.
SHARE = 1 / 20_000
LEAST_COUNT = 3
SLOTS = 1 << 18
PROBES = 3
#: Code points handled at once.
BLOCK = 1 << 20
#: A text of which a smaller part of the n-grams is known to any learned language is in none of them.
REJECT_BELOW = 0.2


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


_LETTER = _letters()


def _grams(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (text number, 64-bit n-gram key); words are padded, n-grams without letters left out."""
    pad = " " * max(ORDERS)
    joined = [pad + t.lower() for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in joined])
    code = np.frombuffer((("".join(joined)) + pad).encode("utf-32-le", "surrogatepass"), "<u4")
    for start in range(0, len(owner), BLOCK):
        stop = min(start + BLOCK, len(owner))
        c = code[start : stop + order - 1].astype(np.uint64)
        letter = (c > 0xFFFF) | _LETTER[np.minimum(c, 0xFFFF).astype(np.int64)]
        c[~letter] = 32
        n = stop - start
        key = np.zeros(n, np.uint64)
        some = np.zeros(n, bool)
        for k in range(order):
            key = key * np.uint64(0x100000001B3) + c[k : k + n]
            some |= letter[k : k + n]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * order)
        yield owner[start:stop][some], (key ^ (key >> np.uint64(32)))[some]


class BitmaskFilter:
    """Bit-sliced Bloom filters of all languages, language-major within a slot."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        self.bytes = max(1, -(-len(languages) // 8))
        self.slots = np.zeros((SLOTS, self.bytes), np.uint8)
        for i, name in enumerate(languages):
            for at in self._places(grams[name]):
                self.slots[at, i // 8] |= 1 << (i % 8)
        fill = np.array([((self.slots[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
        self.false_rate = fill**PROBES

    @staticmethod
    def _places(key: np.ndarray) -> list[np.ndarray]:
        low, high = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32) | np.uint64(1)
        return [((low + np.uint64(k) * high) % np.uint64(SLOTS)).astype(np.int64) for k in range(PROBES)]

    def shares(self, texts: list[str]) -> np.ndarray:
        """For each text and language the corrected share of the text's n-grams that the language has."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(float)
        for order in ORDERS:
            for owner, key in _grams(texts, order):
                if not len(owner):
                    continue
                places = self._places(key)
                mask = self.slots[places[0]]
                for at in places[1:]:
                    mask &= self.slots[at]
                first, n = int(owner[0]), int(owner[-1]) - int(owner[0]) + 1
                local = (owner - first).astype(np.int64) * 256
                for b in range(self.bytes):
                    count = np.bincount(local + mask[:, b], minlength=256 * n).reshape(n, 256)
                    some = slice(8 * b, min(8 * b + 8, len(self.languages)))
                    hits[first : first + n, some] += (count @ bits)[:, : some.stop - some.start]
                    if b == 0:
                        total[first : first + n] += count.sum(1)
        expected = total[:, None] * self.false_rate
        return np.clip((hits - expected) / np.maximum(total[:, None], 1) / (1 - self.false_rate), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether the id's crc32, as text, leaves 2 divided by 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, train: Column, train_docs: int = TRAIN_DOCS, share: float = SHARE) -> BitmaskFilter:
    """Learn from the rows of ``docs`` (doc_id, text, lang) where ``train`` holds and neither is null.

    About ``train_docs`` rows of each language are read for n-grams, chosen by a hash of the id (all or none of
    the rows without one). The driver gets the n-grams of a share of at least ``share``, which are at most ``1 / share`` a
    language, and a few numbers for each value of lang. Repeated rows count each; an empty table teaches nothing.
    """
    spark = docs.sparkSession
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    languages = sorted(r.lang for r in sizes.select("lang").collect())  # a bit of the mask each
    if not languages:
        return BitmaskFilter([], {})
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.join(sizes, "lang").where(draw < train_docs / F.col("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in set(langs):
                own = [t for t, l in zip(texts, langs, strict=True) if l == name]
                for order in ORDERS:
                    for _, key in _grams(own, order):
                        key, n = np.unique(key, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = materialize(chosen.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
                         .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, "lang").where(F.col("n") >= F.greatest(F.lit(float(LEAST_COUNT)), share * F.col("total")))
    grams: dict[str, list[int]] = {name: [] for name in languages}
    for r in frequent.select("lang", "gram").toLocalIterator():
        grams[r.lang].append(r.gram)
    discard(counts, sizes)
    return BitmaskFilter(list(grams), {k: np.array(v, np.int64).view(np.uint64) for k, v in grams.items()})


def identify(docs: DataFrame, model: BitmaskFilter) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) as (doc_id, text, lang_pred, score).

    The whole text is read. A text that is null or has no letter is ``und`` with score 0, and so is any
    text where nothing was learned. Equal shares go to the name that sorts first. The score is the winner's
    corrected share of known n-grams. Repeated rows give repeated rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SLOTS bytes for every eight languages
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        m = shared.value
        for b in pieces(batches):
            texts = b.column(1).to_pylist()
            known = [i for i, ok in enumerate(b.column(2).to_pylist()) if ok] if m.languages else []
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                shares = m.shares([texts[i] for i in known])
                for i, best, s in zip(known, shares.argmax(1), shares.max(1), strict=True):
                    names[i], scores[i] = m.languages[best], s
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "text", "lang_pred", "score"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    return docs.select("doc_id", "text", has_letter).mapInArrow(run, f"doc_id {kind}, text string, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; see ``fit`` and ``identify``."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text is in one of the languages that its own non-null ``lang`` values teach.

    Goes: a text that is null, has no letter, or of whose n-grams under ``REJECT_BELOW`` are known to the
    best language. The model is fitted on rows that are not held out; all columns stay as they are.
    """
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (letter,) = unused(docs, "has_letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        m = shared.value
        for b in pieces(batches):
            keep = np.array([bool(x) for x in b.column(letter).to_pylist()])
            some = np.flatnonzero(keep)
            if len(some):
                texts = b.column("text").to_pylist()
                keep[some] = m.shares([texts[i] for i in some]).max(1) >= REJECT_BELOW if m.languages else False
            yield b.drop_columns([letter]).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, docs.schema)
