"""Token ids on file, in directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 has the first chunk of every id and a bitmap
that says which ids go on; level 1 has the next chunk of those, and so on. A rank directory over each bitmap
gives the place on the next level, so that any token, or any range, is read without decoding a block.

The files are Parquet tables written by Spark, so they reach any file system Spark does: one row for each
shard of about a million ids, with the coded ids, the documents' ids and their starts within the shard.
Shards stand in ascending document order: (part, shard).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_half, give_up, held, pieces, read_table, shared_dir, small_batches

MAGIC = b"DAC1"
#: Bits of a bitmap for each entry of its rank directory.
RANK_BITS = 512
#: A shard is closed when it has so many ids; a longer document has a shard of its own.
SHARD_IDS = 1 << 20
END_ID = 2
#: Distinct words a worker remembers.
CACHE = 800_000


def write_codes(ids: np.ndarray) -> bytes:
    """The coded form of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, np.uint32)
    levels = []
    while True:
        more = rest > 255
        last = not more.any()
        bitmap = b"" if last else np.packbits(more, bitorder="little").tobytes()
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if not last else np.empty(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(counts)[:-1])).astype("<u4").tobytes() if not last else b""
        levels.append((len(rest), rest.astype(np.uint8).tobytes(), bitmap, ranks))
        if last:
            break
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<QQQ", n, len(b), len(r)) for n, _, b, r in levels)
    return head + b"".join(c + b + r for _, c, b, r in levels)


class Codes:
    """Random access to coded ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        (n,) = struct.unpack_from("<I", data, 4)
        at, self.levels = 8 + 24 * n, []
        for k in range(n):
            size, b, r = struct.unpack_from("<QQQ", data, 8 + 24 * k)
            chunks = np.frombuffer(data, np.uint8, size, at)
            bitmap = np.frombuffer(data, np.uint8, b, at + size)
            ranks = np.frombuffer(data, "<u4", r // 4, at + size + b)
            self.levels.append((chunks, bitmap, ranks))
            at += size + b + r

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int, size: int) -> int:
        """Set bits before ``i``."""
        block = min(i // RANK_BITS, len(ranks) - 1)
        start = block * RANK_BITS
        bits = np.unpackbits(bitmap[start // 8 : (i + 7) // 8], bitorder="little")[: i - start]
        return int(ranks[block]) + int(bits.sum(dtype=np.int64))

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, reading only their chunks."""
        out = at = None
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            part = chunks[start:stop].astype(np.uint32)
            if out is None:
                out, at = part, np.arange(len(part))
            else:
                out[at] |= part << np.uint32(8 * k)
            if not len(bitmap) or start >= stop:
                break
            more = np.unpackbits(bitmap[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            start = self._rank(bitmap, ranks, start, len(chunks))
            at = at[more]
            stop = start + len(at)
        return out

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])



def _byte_chars() -> list[str]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


BYTE_CHARS = _byte_chars()
#: Letters and what follows them, which the splitting pattern always parts (an apostrophe may bind letters).
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*)")
#: Texts with these are not lower-cased here: letters beyond the Latin blocks, and what may be a special string.
_BEYOND = re.compile(r"[^\x00-\u024f]|<\|")


class WordTokenizer:
    """The library's ids of whole texts, with the ids of each distinct word kept.

    For vocabularies that drop white space: nothing before a space, tab or newline changes what follows it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.cores: dict[str, bytes] = {"": b""}
        forms = ["the", "été", "straße", "o", "inexplicably", "!?.", "(", "{~"]
        self._ask_model(forms, self.cores)
        #: Whether lower-casing and parting letters from marks is what this tokenizer does itself.
        self.plain = all(self.library.encode(x, add_special_tokens=False).ids == [*array("I", self.cores[f]), *array("I", self.cores[g])]
                         for f in forms[:5] for g in ["", *forms[5:]] for x in (f + g, f.upper().replace("SS", "ß") + g))
        probe = "x. Yz <|endoftext|> !a"
        if self.library.encode(probe, add_special_tokens=False).ids != [i for w in probe.split() for i in self.library.encode(w, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer keeps white space")
        self.words: dict[str, bytes] = {"": b""}

    def _ask(self, new: list[str], known: dict[str, bytes]) -> None:
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            for w, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    def _ask_model(self, new: list[str], known: dict[str, bytes]) -> None:
        """The same for strings that are one pre-token in the form the model sees, without the steps before it."""
        ask = self.model.tokenize
        known.update([(w, array("I", [t.id for t in ask(w if w.isascii() else "".join(map(BYTE_CHARS.__getitem__, w.encode())))]).tobytes()) for w in new])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for t in texts:
            if self.plain and not _BEYOND.search(t):
                t = t.lower()
            split.append(t.replace("\n", " ").split(" "))
        self.words, self.cores = first_half(self.words, CACHE), first_half(self.cores, CACHE // 2)
        words, cores = self.words, self.cores
        new = set().union(*split).difference(words)
        parts: list = []
        odd = list(new)
        if self.plain:
            plain = {w for w in new if w.isascii() and w.isalpha() and w.islower()}
            parts = [(w, _PLAIN.fullmatch(w)) for w in new - plain]
            parts, odd = [(w, m[1], m[2]) for w, m in parts if m], [w for w, m in parts if not m]
        else:
            plain = set()
        need = plain.union([c for _, c, _ in parts], [c for _, _, c in parts]).difference(cores)
        self._ask_model(list(need), cores)
        self._ask(odd, words)
        words.update([(w, cores[w]) for w in plain])
        words.update([(w, cores[a] + cores[b]) for w, a, b in parts])
        return [b"".join(map(words.__getitem__, s)) for s in split]


def tokenizer(path: str) -> WordTokenizer:
    return held("words", path, WordTokenizer)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id``, and write token files at ``out``.

    Documents are dealt by ranges of their id and, where one id has many rows, of a hash of the text; equal
    ids stand in order of that hash and the text. A null id comes first. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        ids, data, size, kind_of = [], [], 0, None

        def close() -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum([len(d) // 4 for d in data]))).astype("<u8")
            codes = write_codes(np.frombuffer(b"".join(data), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([int(starts[-1])], pa.int64()),
                 pa.array([ids], pa.list_(kind_of)), pa.array([starts.tobytes()], pa.binary()), pa.array([codes], pa.binary())],
                ["part", "shard", "start", "n_ids", "doc_ids", "starts", "codes"])

        for b in pieces(batches):
            kind_of = b.column(0).type
            for i, d in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist()), strict=True):
                ids.append(i)
                data.append(d + end)
                size += len(d) // 4 + 1
                if size >= SHARD_IDS:
                    yield close()
                    shard, start, ids, data, size = shard + 1, start + size, [], [], 0
        if ids:
            yield close()

    shards = rows.select("id", "text").mapInArrow(
        run, f"part int, shard int, start long, n_ids long, doc_ids array<{kind}>, starts binary, codes binary")
    with small_batches(docs.sparkSession):
        shards.write.option("compression", "none").parquet(out)


def _bases(files: DataFrame) -> dict[int, int]:
    """How many ids all parts before each one have; the driver sees one sum for each written part."""
    base, total = {}, 0
    for part, n in sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        base[part], total = total, total + n
    return base


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in token files.

    ``start`` counts the ids of all documents before it. Repeated and null ids have a row for each document
    written; files of an empty table give none.
    """
    files = spark.read.parquet(path)
    base = _bases(files)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in batches:
            for k in range(b.num_rows):
                part, start = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                starts = np.frombuffer(b.column(3)[k].as_py(), "<u8").astype(np.int64)
                codes = Codes(b.column(4)[k].as_py())
                crc = [zlib.crc32(codes.slice(s, e).astype("<u4").tobytes()) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(2)[k].values, pa.array(base[part] + start + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "start", "doc_ids", "starts", "codes").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """(range_id, ids) for the rows of ``ranges`` (range_id, start, stop): the ids at these places of token files.

    Only the shards that a range touches are read, and of these only the ids asked for are decoded. What lies
    beyond the files is cut off; ranges that are null, empty or wholly beyond have no row; rows of one range_id
    are one range each only if their places differ.
    """
    files = spark.read.parquet(path)
    base = spark.createDataFrame(list(_bases(files).items()), "part int, base long")
    shards = files.select("part", "shard", "start", "n_ids").join(F.broadcast(base), "part").select("part", "shard", (F.col("base") + F.col("start")).alias("first"), "n_ids").where("n_ids > 0")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / SHARD_IDS), F.floor(b / SHARD_IDS)))
    held = shards.withColumn("bin", bins(F.col("first"), F.col("first") + F.col("n_ids") - 1))
    asked = ranges.where("start is not null").select("range_id", F.greatest("start", F.lit(0)).alias("low"), F.col("stop").alias("high")).where("low < high")
    last = F.lit(sum(r.n for r in shards.agg(F.sum("n_ids").alias("n")).collect() if r.n))
    asked = asked.where(F.col("low") < last).withColumn("bin", bins(F.col("low"), F.least(F.col("high"), last) - 1))
    met = asked.join(held, "bin").where("low < first + n_ids and first < high").select(
        "part", "shard", F.struct("range_id", "low", "high").alias("range"), F.greatest(F.col("low") - F.col("first"), F.lit(0)).alias("from"), F.least(F.col("high") - F.col("first"), "n_ids").alias("to")).distinct()
    counts = met.groupBy("part", "shard").agg(F.ceil(F.count(F.lit(1)) / 10_000).alias("deals"))
    dealt = met.join(counts, ["part", "shard"]).groupBy("part", "shard", F.pmod(F.xxhash64("range"), F.col("deals"))).agg(F.collect_list(F.struct("range", "from", "to")).alias("asked"))
    kind = ranges.schema["range_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches, 1):
            codes, asked = Codes(b.column(2)[0].as_py()), b.column(3)[0].as_py()
            found = [codes.slice(x["from"], x["to"]).astype(np.int64) for x in asked]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["range"]["range_id"] for x in asked], b.column(3).type.value_type.field("range").type.field("range_id").type), pa.array([x["range"]["low"] for x in asked], pa.int64()),
                 pa.array([x["range"]["high"] for x in asked], pa.int64()), pa.array([(b.column(0)[0].as_py() << 32) + b.column(1)[0].as_py()] * len(asked), pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["range_id", "low", "high", "at", "ids"])

    parts = files.select("part", "shard", "codes").join(dealt, ["part", "shard"]).select("part", "shard", "codes", "asked").mapInArrow(run, f"range_id {kind}, low long, high long, at long, ids array<long>")
    whole = parts.groupBy("range_id", "low", "high").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("x"))
    return whole.select("range_id", F.flatten("x.ids").alias("ids"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document; see ``write_tokens`` for nulls, ties and repeats."""
    out = shared_dir(spark)
    write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return read_tokens(spark, out)
