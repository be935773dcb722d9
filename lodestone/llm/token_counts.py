"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair encodings.

The stored table answers "how many tokens has text[:i]" and "how long a prefix fits a budget" without
encoding again. Texts are cut at single spaces where no pre-token can cross, the table of each distinct
piece is computed once per worker (``lattice``), and a text's table is the concatenation of its pieces'.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import first_half, held, pieces, read_table
from .lattice import Lattice, counts_matrix, prefix_counts

LIMIT = 512

#: White space as the tokenizer's splitting pattern knows it (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_SPACES = regex.compile(rf"[{_WS}]+")
_CUT = regex.compile(rf"(?<=[^{_WS}]) (?=[^{_WS}])")
#: White space other than plain spaces and newlines, or next to another white space or an end: cut with ``_CUT``.
_UNUSUAL = regex.compile(r"[\t\x0b-\r\x85\xa0  -     　]|  | \n|\n[ \n]|^ | $")
_CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Distinct pre-tokens a worker remembers, and twice as many pieces of text between spaces.
CACHE = 300_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _steps(counts: np.ndarray) -> bytes:
    step = counts.astype("<i2")
    step[1:] -= step[:-1].copy()
    return step.tobytes()


class PrefixCounter:
    """Prefix tables for one byte-level BPE file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, byte = spec["model"], _byte_symbols()
        if spec.get("normalizer") or model.get("end_of_word_suffix") or model.get("ignore_merges") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only plain byte-level BPE files are supported")
        text = {i: t for t, i in model["vocab"].items()}
        number = {t: k for k, t in enumerate(text[i] for i in sorted(text))}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lattice = Lattice([tuple(byte[c] for c in t) for t in number], [(number[a], number[b], number[a + b]) for a, b in merges])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pre: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _learn(self, pretokens: set[str]) -> None:
        """Steps of the counts at every character of each pre-token not yet known."""
        self.pre = first_half(self.pre, CACHE)
        new = [p for p in pretokens if p not in self.pre]
        data = [p.encode() for p in new]
        by: dict[int, list[int]] = {}
        for i, d in enumerate(data):
            by.setdefault(len(d), []).append(i)
        for length, rows in by.items():
            for k in range(0, len(rows), 8192):
                some = rows[k : k + 8192]
                if length > 64:
                    counts = np.array([prefix_counts(self.lattice.solve([data[i]])[0][1]) for i in some])
                else:
                    words = np.frombuffer(b"".join([data[i] for i in some]), np.uint8).reshape(len(some), length).astype(np.int64)
                    self.lattice.last_pieces(words)
                    counts = counts_matrix(self.lattice._size)
                steps = np.diff(counts, axis=1, prepend=0).astype("<i2").tobytes()
                for r, i in enumerate(some):
                    if len(new[i]) == length:
                        self.pre[new[i]] = steps[2 * r * length : 2 * (r + 1) * length]
                    else:  # the last byte of each character
                        b = np.frombuffer(data[i], np.uint8)
                        self.pre[new[i]] = _steps(counts[r][np.append((b[1:] & 0xC0) != 0x80, True)])

    def _units(self, units: list[str]) -> list[bytes]:
        """Steps of the counts from character to character, for strings that no pre-token leaves."""
        split, odd = [], []
        for i, u in enumerate(units):
            tail = u[1:]
            if tail.isalpha() and (u[0] == " " or u[0].isalpha()):
                split.append((u,))
                continue
            split.append(_PRETOKEN.findall(u))
            if "'" in u or tail and tail.split() != [tail]:
                odd.append(i)
        need = {p for s in split for p in s}
        for i in odd:
            for run in _SPACES.findall(units[i]):
                need.update(run[:m] for m in range(1, len(run) + 1)) if len(run) <= 64 else need.update((run, run[:-1], run[-1:]))
        need.update([c for p in need & _CONTRACTIONS for c in p])
        self._learn(need)
        pre = self.pre
        out = [pre[s[0]] if len(s) == 1 else b"".join([pre[p] for p in s]) for s in split]
        for i in odd:
            out[i] = self._odd_table(units[i], split[i])
        return out

    def _counts(self, pretoken: str) -> np.ndarray:
        return np.cumsum(np.frombuffer(self.pre[pretoken], "<i2"), dtype=np.int64)

    def _odd_table(self, unit: str, pretokens: list[str]) -> bytes:
        """A unit with white space inside or an apostrophe, which are split otherwise where a prefix ends in them."""
        out = np.zeros(len(unit), np.int64)
        for m in _SPACES.finditer(unit):  # as the end of a prefix, a run of white space is one pre-token
            run = m[0]
            out[m.start() : m.end()] = self._counts(run) if len(run) > 64 else [self._counts(run[: k + 1])[-1] for k in range(len(run))]
        at = base = 0
        gap = 0  # count before the run of white space that ``at`` is in
        for p in pretokens:
            c = self._counts(p)
            blank = bool(_SPACES.fullmatch(p))
            if (blank or p[0] == " ") and (at == 0 or not _SPACES.fullmatch(unit[at - 1])):
                gap = base
            if blank:
                out[at : at + len(p)] += gap
            else:
                first = p[0] == " "
                if first:
                    out[at] += gap
                if p in _CONTRACTIONS and len(p) > 2:  # cut short it is a mark and letters
                    c[1] = 1 + self._counts(p[1])[-1]
                out[at + first : at + len(p)] = base + c[first:]
            base += int(np.frombuffer(self.pre[p], "<i2").sum())
            at += len(p)
        return _steps(out)

    def _segment_parts(self, text: str) -> list[str]:
        """Units: all but the first follow a space, or begin with the newline that they follow."""
        return _CUT.split(text) if _UNUSUAL.search(text) else text.replace("\n", " \n").split(" ")

    def tables(self, texts: list[str]) -> list[bytes]:
        """For each text the differences of its prefix counts, two bytes a character."""
        split, need_bare, need_spaced = [], set(), set()
        self.spaced, self.bare = first_half(self.spaced, 2 * CACHE), first_half(self.bare, CACHE)
        for text in texts:
            jobs = []
            if text:
                at = 0
                for m in self.cut_special.finditer(text) if self.cut_special else ():
                    jobs.append((self._segment_parts(text[at : m.start()] + m[0][:-1]), len(m[0])))
                    if m.start() > at:
                        jobs.append((self._segment_parts(text[at : m.start()]), -1))
                    at = m.end()
                if at < len(text):
                    jobs.append((self._segment_parts(text[at:]), 0))
            split.append(jobs)
            for parts, _ in jobs:
                need_bare.add(parts[0])
                need_spaced.update(parts[1:])
        bare = [w for w in need_bare if w not in self.bare]
        spaced = [w for w in need_spaced if w not in self.spaced]
        found = self._units(bare + [w if w[0] == "\n" else " " + w for w in spaced])
        self.bare.update(zip(bare, found[: len(bare)], strict=True))
        self.spaced.update(zip(spaced, found[len(bare) :], strict=True))
        return [self._joined(jobs) for jobs in split]

    def _joined(self, jobs) -> bytes:
        spaced, out, k = self.spaced, [], 0
        while k < len(jobs):
            parts, special = jobs[k]
            table = self.bare[parts[0]] + b"".join([spaced[w] for w in parts[1:]])
            if special:  # the text before a special string, that string but its last character, then the token
                cut = np.frombuffer(table, "<i2").astype(np.int64)
                whole = 0
                if k + 1 < len(jobs) and jobs[k + 1][1] == -1:
                    k += 1
                    before = jobs[k][0]
                    whole = int(np.frombuffer(self.bare[before[0]] + b"".join([spaced[w] for w in before[1:]]), "<i2").sum())
                table += np.array([whole + 1 - cut.sum()], "<i2").tobytes()
            out.append(table)
            k += 1
        return b"".join(out)


def counter(path: str) -> PrefixCounter:
    return held("counter", path, PrefixCounter)


def tokens_in_prefix(table: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters, from a stored table."""
    return int(np.frombuffer(table, "<i2", min(n_chars, len(table) // 2)).sum(dtype=np.int64))


def longest_prefix(table: bytes, budget: int) -> int:
    """Length in characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(table, "<i2"), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None, tables: bool = True) -> DataFrame:
    """(id, n_bytes, n_tokens, prefix_chars, prefix_table) for every row.

    ``path`` names a byte-level BPE file, which every worker must have (library data, not input). A null
    text counts as empty: no bytes, no tokens, an empty table. The table has two bytes a character:
    the change of the token count there. ``prefix_chars`` is the length of the longest prefix of at most ``budget``
    tokens, read from the table (null without a budget); with ``tables`` off the table itself stays out.
    Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in pieces(batches, 1_000):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = c.tables(texts)
            columns = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                       pa.array([int(np.frombuffer(t, "<i2").sum(dtype=np.int64)) for t in found], pa.int64()),
                       pa.array([None if budget is None else longest_prefix(t, budget) for t in found], pa.int64())]
            if tables:
                columns.append(pa.array(found, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "prefix_chars", "prefix_table"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
            .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, prefix_chars long" + ", prefix_table binary" * tables).withColumnRenamed("id", id_col))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, prefix_chars) of every document; see ``prefix_token_counts``."""
    found = prefix_token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=LIMIT, tables=False)
    return found.select("doc_id", "n_bytes", "n_tokens", (found.n_tokens > LIMIT).alias("over_limit"), "prefix_chars")
