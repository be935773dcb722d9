"""A reranker of the library's own: late interaction of words.

A word's vector has a one for each three letters in a row of it, its edges included. Each significant word of a query is held
against the word of a text whose vector is nearest by cosine, and counts by how rare it is among all chunks; the score is
the weighted mean, 0 to 1. So inflected and misspelt words count for most of what the word itself would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ident
from ..functions.columns import unused
from .postings import BROADCAST_WORDS


def letter_triples(word: Column) -> Column:
    """The distinct three letters in a row of a word between two spaces."""
    edged = F.concat(F.lit(" "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.substring(edged, i, F.lit(3))))


def word_weights(chunks: DataFrame, queries: DataFrame, text_col: str = "content") -> DataFrame:
    """(query_id, weights) of ``queries`` (query_id, query): the significant words, each with its letter triples and the weight
    ``ln(1 + N / n)``, for N chunks of which n, at least 1, have the word. Queries without such words have none."""
    asked = queries.select("query_id", F.explode(F.array_distinct(ident.significant_words(F.col("query")))).alias("word"))
    words = asked.select("word").distinct()
    few = words.count() <= BROADCAST_WORDS
    lower = F.explode(F.array_distinct(ident.words_of(F.lower(F.col(text_col))))).alias("word")
    known = chunks.select(lower).join(F.broadcast(words) if few else words, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = chunks.agg(F.count(F.lit(1)).alias("total"))  # one row
    weight = F.log(1 + F.col("total") / F.coalesce("n", F.lit(1)))
    each = asked.join(known, "word", "left").crossJoin(F.broadcast(total)).select("query_id", F.struct("word", letter_triples(F.col("word")).alias("triples"), weight.alias("weight")).alias("w"))
    return each.groupBy("query_id").agg(F.array_sort(F.collect_list("w")).alias("weights"))


def interaction(weights: Column, text: Column) -> Column:
    """The score of a text by the weights of a query; 0 for a null text and a query without words."""
    words = F.transform(F.array_distinct(ident.words_of(F.lower(text))), letter_triples)

    def of(found: Column) -> Column:
        like = lambda a, b: F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b))
        best = lambda w: F.coalesce(F.array_max(F.transform(found, lambda t: like(t, w.triples))), F.lit(0.0))
        return F.aggregate(weights, F.lit(0.0), lambda s, w: s + w.weight * best(w))

    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w.weight)
    # the text's words are bound once for all words of the query
    score = F.element_at(F.transform(F.array(F.coalesce(words, F.array().cast("array<array<string>>"))), of), 1)
    return F.coalesce(score / F.nullif(total, F.lit(0.0)), F.lit(0.0))


def with_interaction(hits: DataFrame, weights: DataFrame, score: str = "score", few: bool = True) -> DataFrame:
    """``hits`` (query_id, content, ...) with the column ``score``; ``few`` queries are broadcast."""
    (own,) = unused(hits, "weights")
    weights = weights.select("query_id", F.col("weights").alias(own))
    joined = hits.join(F.broadcast(weights) if few else weights, "query_id", "left")
    return joined.withColumn(score, interaction(F.col(own), F.col("content"))).drop(own)
