"""SentencePiece byte-pair models: encoding by batched numpy search, and decoding.

The model at hand is a byte-pair model with byte fallback, for which the best-scoring path of a plain
Viterbi search is not the model's result. The search therefore only lets pieces follow each other that the
merges could have left side by side (see ``lattice``); then one path is left, and it is the library's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_half, held, pieces, read_table
from .lattice import Lattice, agenda_encode, backtrack

MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Distinct words a worker remembers.
CACHE = 400_000
MODEL = "piece_bpe_32k.model"


def _kinds(model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts of the pieces, which are not ordinary text, and the ids of the 256 bytes."""
    n = model.vocab_size()
    text = [model.id_to_piece(i) for i in range(n)]
    odd = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)])
    byte_id = np.zeros(256, np.int32)
    for i in np.flatnonzero(odd).tolist():
        if model.is_byte(i):
            byte_id[int(text[i][3:5], 16)] = i
    return text, odd, byte_id


class Decoder:
    """Texts of ids."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        text, odd, byte_id = _kinds(model)
        surface = [t.replace(MARK, " ").encode() for t in text]
        for i in np.flatnonzero(odd).tolist():
            surface[i] = b"" if model.is_control(i) else " \u2047 ".encode()
        for b, i in enumerate(byte_id.tolist()):
            surface[i] = bytes([b])
        self.surface = np.array(surface, object)
        self.marked = np.array([t.startswith(MARK) for t in text]) & ~odd
        self.control = np.array([model.is_control(i) for i in range(len(text))])

    def decode(self, ids: np.ndarray, stops: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ``ids`` that end before ``stops``."""
        parts, out, start = self.surface[ids].tolist(), [], 0
        for stop in stops.tolist():
            data, first = b"".join(parts[start:stop]), start
            while first < stop and self.control[ids[first]]:
                first += 1
            if first < stop and self.marked[ids[first]]:
                data = data[1:]
            out.append(data.decode("utf-8", "replace"))
            start = stop
        return out


class Encoder:
    """Ids of texts, for one model file with identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("  a  b", out_type=str) != [MARK * 2, MARK + "a", MARK, MARK + "b"] or model.normalize("\ufb01  A") != f"{MARK}\ufb01{MARK * 2}A":
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        text, odd, self.byte_id = _kinds(model)
        normal = [i for i in range(len(text)) if not odd[i]]
        number = {text[i]: k for k, i in enumerate(normal)}
        self.ids = np.array([*normal, -1], np.int32)
        score = {k: -model.get_score(i) for k, i in enumerate(normal)}
        self.merged: dict[tuple[int, int], tuple[float, int]] = {}
        for t, k in number.items():
            for cut in range(1, len(t)):
                a, b = number.get(t[:cut]), number.get(t[cut:])
                if a is not None and b is not None:
                    self.merged[a, b] = (score[k], k)
        # Runs of the mark share one score, so merge order alone decides them: left to the agenda.
        plain = {pair: m for pair, m in self.merged.items() if MARK * 2 not in text[normal[m[1]]]}
        self.base = {t: k for t, k in number.items() if len(t) == 1}
        merges = []
        for t, k in sorted(number.items(), key=lambda x: score[x[1]]):
            if len(t) == 1 or MARK * 2 in t:
                continue
            if MARK in t[1:]:
                raise ValueError("a piece reaches over a word's start")
            without = _Without(plain, k)
            halves = agenda_encode([self.base[c] for c in t], without)
            if len(halves) == 2 and plain.get(tuple(halves), (0, -1))[1] == k:
                merges.append((*halves, k))
        self.lattice = Lattice([tuple(map(ord, text[i])) if MARK * 2 not in text[i] else (-2, k) for k, i in enumerate(normal)], merges)
        self.words: dict[str, bytes] = {}

    def _bytes_of(self, pieces: list[int], unit: str) -> bytes:
        """Ids of a unit's pieces, with bytes for characters that no piece has."""
        out: list[int] = []
        unknown = [c for c in unit if c not in self.base]
        at = 0
        for p in pieces:
            if p == self.lattice.unknown:
                out += self.byte_id[list(unknown[at].encode())].tolist()
                at += 1
            else:
                out.append(int(self.ids[p]))
        return np.array(out, "<i4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of units, which are known by what follows their first mark."""
        by: dict[int, list[str]] = {}
        for w in words:
            if MARK in w:
                u = MARK + w
                self.words[w] = self._bytes_of(agenda_encode([self.base.get(c, self.lattice.unknown) for c in u], self.merged), u)
            elif len(w) > 63:
                u = MARK + w
                last, size = self.lattice.solve([list(map(ord, u))])[0]
                self.words[w] = self._bytes_of(backtrack(last, size), u)
            else:
                by.setdefault(len(w) + 1, []).append(w)
        for length, some in by.items():
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                mat = np.frombuffer((MARK + MARK.join(part)).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), length).astype(np.int64)
                last = self.lattice.last_pieces(mat)
                size = self.lattice._size
                rows, end, column = np.arange(len(part)), np.full(len(part), length), length
                path = np.full((len(part), length), -1, np.int64)
                used = np.zeros(len(part), np.int64)
                while (on := end > 0).any():  # all words step back together
                    column -= 1
                    e = np.maximum(end - 1, 0)
                    path[on, length - 1 - used[on]] = last[rows[on], e[on]]
                    used += on
                    end = np.where(on, end - size[rows, e], 0)
                ids = self.ids[path].astype("<i4").tobytes()
                strange = (path == self.lattice.unknown).any(1)
                starts = (4 * (np.arange(1, len(part) + 1) * length - used)).tolist()
                stops = range(4 * length, 4 * length * (len(part) + 1), 4 * length)
                self.words.update(zip(part, [ids[a:b] for a, b in zip(starts, stops, strict=True)], strict=True))
                for r in np.flatnonzero(strange).tolist():
                    self.words[part[r]] = self._bytes_of(path[r, length - used[r] :].tolist(), MARK + part[r])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = []
        for t in texts:
            if not t:
                split.append(())
            elif MARK in t or "  " in t or t[0] == " " or t[-1] == " ":
                split.append([u[1:] for u in _UNITS.findall(MARK + t.replace(" ", MARK))])
            else:
                split.append(t.split(" "))
        self.words = words = first_half(self.words, CACHE)
        self._learn(list(set().union(*split).difference(words)))
        return [b"".join(map(words.__getitem__, s)) for s in split]


class _Without(dict):
    """The merges but those that make one piece."""

    def __init__(self, merges: dict, piece: int):
        self.merges, self.piece = merges, piece

    def get(self, pair, default=None):
        found = self.merges.get(pair)
        return default if found is None or found[1] == self.piece else found


def encoder(path: str) -> Encoder:
    return held("encoder", path, Encoder)


def decoder(path: str) -> Decoder:
    return held("decoder", path, Decoder)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids array<int>, ids_crc32) for every row. A null text counts as empty and gives an empty array.

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers. With ``decode``
    there is a column ``decoded`` too, the text that the ids stand for, made in the same pass. Repeated rows
    give repeated rows; other columns are ignored. ``path`` is a model file every worker has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = encoder(path)
        back = Decoder(path) if decode else None
        for b in pieces(batches):
            coded = c.encode([t or "" for t in b.column(1).to_pylist()])
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded]))).astype(np.int32)
            flat = np.frombuffer(b"".join(coded), "<i4")
            columns = [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([zlib.crc32(x) for x in coded], pa.int64())]
            if back:
                columns.append(pa.array(back.decode(flat, offsets[1:]), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "ids_crc32", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, ids_crc32 long" + ", decoded string" * decode
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_pieces(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with a column more: the text of its ids. A null array gives null; ids that the model does not
    have fail the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(path)
        for b in pieces(batches):
            lists = b.column(ids_col)
            stops = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts = pa.array(d.decode(lists.flatten().to_numpy(zero_copy_only=False), stops), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pc.if_else(lists.is_valid(), texts, None)], [*b.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids again, and returns digests of both."""
    path = public_tokenizers.path(MODEL)
    decoded = encode_pieces(read_table(spark, sf_dir, "documents"), path, decode=True)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("text_sha256"))
