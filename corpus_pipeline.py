"""Corpus preparation in stages, each reading what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language_id, near_dedup, sentencepieces, substring_dedup
from lodestone.llm.common import discard, materialize, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or without letters, and those in no learned language, go. If no row has a lang, all go."""
    return language_id.keep_known_languages(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each near-duplicate group, one row of it. Rows without an id stay
    if no row with one has their text."""
    return near_dedup.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that a document with a smaller id has go; all documents stay, emptied ones too, and
    those without an id as they are."""
    return substring_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts and items overlap with nothing."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, text): the ids of each text, and the text they decode to; a null text counts as empty."""
    path = public_tokenizers.path(sentencepieces.MODEL)
    coded = sentencepieces.encode_pieces(docs, path, decode=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL cannot express the learned, sketched and tokenising stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written out; what a stage has read goes once its own is there."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, last = materialize(docs), before
            before = docs
            if last is not None:
                discard(last)
    return docs
