"""Fixed and overlapping word chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.let import let
from textloom.functions.tokens import white_words


def chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of (text, tokens): windows of ``size`` words that start every ``size - overlap`` words.

    A last window inside its predecessor is kept; text without words has none.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunks need size > overlap >= 0")

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size - overlap))
        parts = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, size), " ").alias("text"), F.least(F.lit(size), F.size(w) - i + 1).cast("bigint").alias("tokens")))
        return F.filter(parts, lambda p: p["tokens"] > 0)

    return let(white_words(text), cut)


def chunk_id(path: Column, index: Column) -> Column:
    """``<path with / and spaces as _>_chunk<4 digits>``."""
    return F.format_string("%s_chunk%04d", F.translate(path, "/ ", "__"), index)


def preview(parts: Column, limit: int = 3, length: int = 180) -> Column:
    """The first chunks, each cut to ``length`` characters with ``...`` if it was longer."""
    short = lambda t: F.concat(F.substring(t, 1, length), F.when(F.length(t) > length, "...").otherwise(""))
    return F.transform(F.slice(parts, 1, limit), lambda p: F.struct(short(p["text"]).alias("text"), p["tokens"].alias("tokens")))
