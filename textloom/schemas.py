"""Declared schemas and schema-level helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DOCUMENT = "doc_id string, text string, label string, source string, n_chars bigint, n_words bigint, s3_key string"
UNIT = "doc_id string, unit_id string, text string, label string, source string, split string, n_chars bigint, n_words bigint, s3_key string"
CHUNK = "document_id string, chunk_text string, label string, source_path string, tokens bigint"
SCORE = "document_id string, rouge_precision double, rouge_recall double, rouge_f1 double, bleu double, precision double, recall double, f1 double"
PAIR = "medical string, plain string, context string, pair_id string, flesch_score double"

#: The order in which a text column is looked for.
TEXT_CANDIDATES = ("chunk_text", "clean_text", "text")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df``, or a ValueError that lists the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def pick_column(df: DataFrame, candidates: Sequence[str] = TEXT_CANDIDATES) -> str:
    """The first candidate that exists, else the first column."""
    return next((c for c in candidates if c in df.columns), df.columns[0])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def priority_columns(df: DataFrame, priority: Sequence[str], limit: int) -> list[str]:
    """The numeric columns of ``priority`` in its order, ``limit`` at most; the first numeric column if none is there."""
    numeric = numeric_columns(df)
    return [c for c in priority if c in numeric][:limit] or numeric[:1]


def replace_columns(df: DataFrame, new: Sequence[str]) -> DataFrame:
    """``df`` without the columns that collide with ``new``."""
    return df.drop(*(c for c in df.columns if c in new))


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select ``mapping``'s keys under its values' names; an empty input keeps the schema."""
    return require_columns(df, list(mapping)).select(*(df[old].alias(new) for old, new in mapping.items()))
