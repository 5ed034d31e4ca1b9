"""Words, sentences, syllables and n-grams as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"[.!?]+"


def white_words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def n_white_words(text: Column) -> Column:
    """``size(white_words)`` without the array."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("bigint")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and ``_``."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def sentence_pieces(text: Column) -> Column:
    """All pieces between runs of ``.!?``, blank ones included."""
    return F.split(F.coalesce(text, F.lit("")), SENTENCE_END)


def sentences(text: Column) -> Column:
    """Pieces that aren't blank, trimmed."""
    trimmed = F.transform(sentence_pieces(text), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def n_sentences(text: Column) -> Column:
    """Non-blank pieces, 1 at least: the runs of other characters that hold something but white space."""
    found = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^.!?\s][^.!?]*"))
    return F.greatest(found, F.lit(1)).cast("bigint")


def syllables(word: Column) -> Column:
    return F.greatest(F.regexp_count(word, F.lit("[aeiouy]+")), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams, joined by a character that tokens don't have."""
    count = F.size(tokens) - n + 1
    whole = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), "\x1f"))
    return F.when(count >= 1, whole).otherwise(F.array().cast("array<string>"))
