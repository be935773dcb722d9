"""Toxicity by bags of subwords, averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams, its edges included, and of its own vector; all are hashed into
one table. A window of words is the mean of its words, in which a word that was there a few words before adds nothing, and a
linear softmax over that mean says how likely it is toxic. Vectors and softmax are trained together: a text is as toxic as its most toxic window, so the windows of a
text share its label by how toxic they already look. A misspelt word that was never seen still has most of
its n-grams. As everything after the table is linear, scoring needs one number for each entry of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_up, materialize, pieces, read_table

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
DIM = 8
#: Words of a window; windows overlap by half.
SPAN = 16
#: Labelled documents of each label that the model is fitted on, about: those with the smallest hashes of their id, in
#: order until their texts have so many code points; texts longer than ``TRAIN_LONGEST`` are not among them.
TRAIN_DOCS = 2_000
TRAIN_CHARS = 24_000_000
TRAIN_LONGEST = 240_000
#: Steps of training, over so many texts each, and their size at first. Both labels count alike, whatever their numbers.
STEPS, BATCH, RATE = 600, 40, 0.4
#: A text is predicted toxic from this score on.
TOXIC_FROM = 0.7
#: Code points scored at once.
BLOCK = 1 << 20

_WORD = np.array([chr(i).isalnum() for i in range(0x10000)])


def _mix(key: np.ndarray, order: int) -> np.ndarray:
    h = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * order)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)


class Bags:
    """The words of some texts: runs of letters and digits, in lower case, each between two spaces in ``code``.

    ``start`` and ``length`` say where a word stands, ``count`` how many words each text has.
    """

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        code = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        word = (code > 0xFFFF) | _WORD[np.minimum(code, 0xFFFF)]
        opens = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        text_ends = np.cumsum([len(t) + 1 for t in lower])
        self.count = np.diff(np.searchsorted(opens, text_ends), prepend=0)
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[0] = True
        self.code = np.where(word, code, 32)[keep].astype(np.uint64)
        space = np.flatnonzero(self.code == 32)
        self.start, self.length = space[:-1] + 1, np.diff(space) - 1
        self.size = 1 + sum(np.maximum(0, self.length + 3 - k) for k in ORDERS)  # subwords of each word

    def words(self) -> list[str]:
        return self.code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.arange(len(self.code)) - np.repeat(np.r_[0, self.start], np.diff(np.r_[0, self.start, len(self.code)]))
        power = np.cumprod(np.full(at.max() + 1, 0x9E3779B97F4A7C15, np.uint64))
        return np.add.reduceat(np.where(self.code == 32, np.uint64(0), self.code * power[at]), self.start)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order (place of each n-gram within a word and its edges, bucket)."""
        spaces = np.cumsum(self.code == 32)
        key = self.code
        for k in range(2, max(ORDERS) + 1):
            key = key[:-1] * np.uint64(0x100000001B3) + self.code[k - 1 :]
            if k in ORDERS:
                at = np.flatnonzero(spaces[k - 2 : len(key) + k - 2] == spaces[: len(key)])
                yield at, _mix(key[at], k)


def _windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, text) of the windows of texts with so many words; a text without words has none."""
    half = SPAN // 2
    n = np.where(count > 0, np.maximum(1, -(-(count - half) // half)), 0)
    text = np.repeat(np.arange(len(count)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.cumsum(count) - count
    start = first[text] + number * half
    return start, np.minimum(start + SPAN, (first + count)[text]), text


def _said(word: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each word, of texts with so many words, is one of the ``SPAN`` words before it in its text."""
    text, out = np.repeat(np.arange(len(count)), count), np.zeros(len(word), bool)
    for k in range(1, min(SPAN + 1, len(word))):
        out[k:] |= (word[k:] == word[:-k]) & (text[k:] == text[:-k])
    return out


class SubwordModel:
    """``weight`` has what each bucket says for label 1 over label 0, ``bias`` what no word says; ``constant`` is the score
    of every text where fewer than two labels were learned."""

    def __init__(self, weight: np.ndarray, bias: float, constant: float | None = None):
        self.weight, self.bias, self.constant = weight, bias, constant

    def _word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bags = Bags(texts)
        total = np.zeros(len(bags.code))
        for at, bucket in bags.grams():
            total[at] += self.weight[bucket]  # a place stands once in each order
        word = bags.hashes()
        if not len(word):
            return np.zeros(0), bags.count
        scores = (np.add.reduceat(total, bags.start - 1) + self.weight[_mix(word, 1)]) / bags.size
        return np.where(_said(word, bags.count), 0, scores), bags.count

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 of each text's most toxic window."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        value, count = [], np.zeros(len(texts), np.int64)
        group, owner, size = [], [], 0
        for i, text in enumerate(texts):
            for part in _parts(text):
                if group and size + len(part) > BLOCK:
                    self._score(group, owner, value, count)
                    group, owner, size = [], [], 0
                group.append(part)
                owner.append(i)
                size += len(part) + 1
        self._score(group, owner, value, count)
        best = np.zeros(len(texts))
        start, end, text = _windows(count)
        if len(start):  # sums of half windows: they do not depend on the texts before
            value, half = np.append(np.concatenate(value), 0.0), np.minimum(start + SPAN // 2, end)
            low, high = (np.add.reduceat(value, np.stack((a, b), axis=1).ravel())[::2] for a, b in ((start, half), (half, end)))
            each = (low + np.where(half < end, high, 0)) / (end - start)
            some, first = np.unique(text, return_index=True)
            best[some] = np.maximum.reduceat(each, first)
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -500, 500)))

    def _score(self, group: list[str], owner: list[int], value: list[np.ndarray], count: np.ndarray) -> None:
        if group:
            scores, n = self._word_scores(group)
            value.append(scores)
            np.add.at(count, owner, n)


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about ``BLOCK`` code points, none of which ends within a word."""
    at = 0
    while len(text) - at > BLOCK:
        end = at + BLOCK
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def train(texts: list[str], labels: list[int], seed: int = 11) -> SubwordModel:
    """Vectors of subwords and softmax, fitted together with adaptive gradient steps."""
    if len(set(labels)) < 2:
        return SubwordModel(np.zeros(BUCKETS, np.float32), 0.0, float(np.mean(labels)) if labels else 0.0)
    known: dict[str, int] = {}
    docs, counts = [], []
    for text in texts:
        words = Bags([text]).words()
        docs.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        counts.append(len(words))
    subwords, first = _vocabulary(list(known))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    softmax, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    table_g, softmax_g, bias_g = np.full(BUCKETS, 1e-8), np.full(softmax.shape, 1e-8), np.full(2, 1e-8)
    labels = np.array(labels)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    some = np.array([i for i, n in enumerate(counts) if n], np.int64)
    parts = max(1, len(some) // BATCH)
    epochs = max(1, round(STEPS / parts))
    for epoch in range(epochs if len(some) else 0):
        rate = RATE * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(some), parts):
            words, place = np.unique(np.concatenate([docs[i] for i in batch]), return_inverse=True)
            size = first[words + 1] - first[words]
            at = np.cumsum(size) - size
            grams = subwords[np.repeat(first[words] - at, size) + np.arange(size.sum())]
            vectors = np.add.reduceat(table[grams], at) / size[:, None]
            start, end, text = _windows(np.array([counts[i] for i in batch]))
            fresh = ~_said(place, np.array([counts[i] for i in batch]))[:, None]
            sums = np.vstack((np.zeros(DIM), np.cumsum(vectors[place] * fresh, axis=0)))
            means = (sums[end] - sums[start]) / (end - start)[:, None]
            logits = means @ softmax + bias
            p = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -50, 50)))
            # a window's part in its text: larger the more toxic it looks
            lead = logits[:, 1] - logits[:, 0]
            opens = np.r_[0, np.flatnonzero(np.diff(text)) + 1]
            part = np.exp(lead - np.repeat(np.maximum.reduceat(lead, opens), np.diff(np.r_[opens, len(text)])))
            part /= np.repeat(np.add.reduceat(part, opens), np.diff(np.r_[opens, len(text)]))
            wrong = part * (p - labels[batch][text]) * weight[batch][text] / len(batch)
            slope = np.stack((-wrong, wrong), axis=1)
            to_means = slope @ softmax.T / (end - start)[:, None]
            to_softmax, to_bias = means.T @ slope, slope.sum(0)
            change = np.stack([np.bincount(start, g, len(place) + 1) - np.bincount(end, g, len(place) + 1) for g in to_means.T], axis=1)
            to_words = np.cumsum(change, axis=0)[:-1] * fresh
            to_vectors = np.stack([np.bincount(place, g, len(words)) for g in to_words.T], axis=1) / size[:, None]
            used = np.flatnonzero(np.bincount(grams, minlength=BUCKETS))
            to_table = np.stack([np.bincount(grams, np.repeat(g, size), BUCKETS)[used] for g in to_vectors.T], axis=1)
            table_g[used] += (to_table**2).mean(1)
            table[used] -= rate * to_table / np.sqrt(table_g[used])[:, None]
            softmax_g += to_softmax**2
            softmax -= rate * to_softmax / np.sqrt(softmax_g)
            bias_g += to_bias**2
            bias -= rate * to_bias / np.sqrt(bias_g)
    return SubwordModel((table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _vocabulary(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all subwords, where each word's begin and, at the end, their number)."""
    bags = Bags([" ".join(words)])
    number = np.zeros(len(bags.code) + 1, np.int64)
    number[bags.start] = 1
    number = np.cumsum(number) - 1  # of the word at or before each place
    owner, bucket = [np.arange(len(bags.start))], [_mix(bags.hashes(), 1)]
    for at, b in bags.grams():
        owner.append(number[at + 1])
        bucket.append(b)
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    return bucket[np.argsort(owner, kind="stable")], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]


def held_out(doc_id: Column) -> Column:
    """Whether the id's crc32, as text, leaves 1 divided by 3. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> SubwordModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) of ids for which ``train_on``, a column over doc_id, holds.

    An id is toxic if any of its labels is not 0; rows with a null id, label or text teach nothing, and of an id with several
    texts one teaches. About ``train_docs`` ids of each label are sampled, and their texts, ``train_chars`` code points at most,
    go to the driver. Where one label or none is there, every text scores the share of toxic ids, 0 without any.
    """
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    known = (labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train_on)
             .groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return SubwordModel(np.zeros(BUCKETS, np.float32), 0.0, float(max(sizes, default=0)))
    share = F.when(F.col("toxic") == 1, min(1.0, train_docs / sizes[1])).otherwise(min(1.0, train_docs / sizes[0]))
    some = F.broadcast(known.where(draw < share))  # about 2 * train_docs rows
    texts = (docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where(F.length("text") <= TRAIN_LONGEST).join(some, "doc_id")
             .groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    texts = materialize(texts.withColumn("draw", draw))
    sizes = texts.select("draw", F.length("text").alias("n")).orderBy("draw").toArrow()
    if not sizes.num_rows:
        return SubwordModel(np.zeros(BUCKETS, np.float32), 0.0, 0.0)
    fits = np.cumsum(sizes["n"].to_numpy()) <= train_chars
    last = sizes["draw"].to_numpy()[max(0, int(fits.sum()) - 1)]
    rows = texts.where(F.col("draw") <= float(last)).orderBy("draw", "doc_id").select("text", "toxic").toArrow()
    discard(texts)
    return train(rows["text"].to_pylist(), rows["toxic"].to_pylist())


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text): how likely the whole text is toxic, 0 to 1.

    A null text counts as empty, and a text without letters and digits has the score that no words have. Repeated
    rows give repeated rows with the same score; ids may be null. An empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches, 200):
            scores = shared.value.scores([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see ``fit`` and ``score``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
