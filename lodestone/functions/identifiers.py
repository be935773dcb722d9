"""What a query says: code identifiers, significant words, and how much a text is lifted by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifier styles and the stop list are part of the query semantics.
CAMEL_CASE = r"\b[a-z]+(?:[A-Z][a-z0-9]*)+\b"
PASCAL_CASE = r"\b[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)+\b"
SNAKE_CASE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
SCREAMING_CASE = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did "
    "will would should could may might must can this that these those what which who when where why how "
    "code function class method file logic"
).split()

BASE_BOOST = 3.0
WORD_BOOST = 1.2


def identifiers(query: Column) -> Column:
    """Distinct identifiers of a query, by style and then by place; null for a null query."""
    found = [F.regexp_extract_all(query, F.lit(p), F.lit(0)) for p in (CAMEL_CASE, PASCAL_CASE, SNAKE_CASE, SCREAMING_CASE)]
    return reduce(F.array_union, found)


def significant_words(query: Column) -> Column:
    """Distinct lower-case words of more than two characters that the stop list does not have."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def words_of(text: Column) -> Column:
    """The whole words of a text; taken once, it serves any number of queries."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def identifier_matches(names: Column, text_words: Column, case_sensitive: bool = True) -> Column:
    """How many of the identifiers are among the words of a text (``words_of``)."""
    if not case_sensitive:
        names, text_words = F.transform(names, F.lower), F.transform(text_words, F.lower)
    return F.size(F.array_intersect(names, text_words))


def has_exact_match(names: Column, text_words: Column, case_sensitive: bool = True) -> Column:
    return identifier_matches(names, text_words, case_sensitive) > 0


def has_significant_word(words: Column, lower_text_words: Column) -> Column:
    """Whether any significant word is among the words of the lower-cased text."""
    return F.arrays_overlap(words, lower_text_words)


def boost(names: Column, words: Column, text: Column, base: float = BASE_BOOST, text_words: Column | None = None, lower_text_words: Column | None = None) -> Column:
    """Factor for a text: ``base`` for one identifier and half of it more for each further one; without
    identifiers in the query a little for any significant word; else one.

    The words of the text, and of it lower-cased, can be given where they are columns already.
    """
    n = identifier_matches(names, words_of(text) if text_words is None else text_words)
    lower = words_of(F.lower(text)) if lower_text_words is None else lower_text_words
    named = F.when(n == 0, 1.0).otherwise(base * (1 + (n - 1) * 0.5))
    return F.when(F.size(names) > 0, named).when(has_significant_word(words, lower), WORD_BOOST).otherwise(1.0)
