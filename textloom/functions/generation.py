"""Prompts, generated text, and the numbers around decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import tokens
from textloom.functions.let import ratio

#: The prompt's wording and the marker that the answer follows.
INSTRUCTION = (
    "You are a specialist in healthcare communication. "
    "Use the context to transform the following medical text into a clear, "
    "concise, and easy-to-understand summary for a patient and their family. "
    "Retain all relevant clinical data, but explain technical terms using simple "
    "language and short sentences.\n\n"
)
TEXT_MARK, ANSWER_MARK = "### Medical text:\n", "### Simplified summary:\n"
#: Readability of texts too short to score, and the band limits of Flesch scores.
DEFAULTS = {
    "flesch_reading_ease": 30.0, "flesch_kincaid_grade_level": 12.0, "coleman_liau_index": 12.0,
    "gunning_fog_index": 12.0, "smog_index": 12.0, "dale_chall_readability_score": 9.0,
}
BANDS = ((80, "very_easy"), (60, "easy"), (50, "moderate"), (30, "difficult"))


def prompt(text: Column, answer: Column | None = None) -> Column:
    """The prompt; with the answer at its end for training."""
    return F.concat(F.lit(INSTRUCTION + TEXT_MARK), text, F.lit("\n\n" + ANSWER_MARK), answer if answer is not None else F.lit(""))


def extract_answer(generated: Column) -> Column:
    """The trimmed text after the last marker, or all of it."""
    return F.regexp_replace(F.substring_index(generated, ANSWER_MARK.strip(), -1), r"(?U)^\s+|\s+$", "")


def drop_echo(generated: Column, text: Column) -> Column:
    """The output without copies of the input; all of the output if nothing is left."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rest = strip(F.when(F.length(text) > 0, F.replace(generated, text, F.lit(""))).otherwise(generated))
    return F.when(rest != "", rest).otherwise(strip(generated))


def flesch_band(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for limit, name in BANDS:
        out = out.when(score >= limit, name)
    return out.otherwise("very_difficult")


def readability_or_default(text: Column, stats: Column, with_tools: bool = False) -> dict[str, Column]:
    """Readability scores, Flesch kept in 0..100; defaults below 10 characters.

    ``stats`` are from ``metrics.word_statistics``, or, ``with_tools``, from
    ``metrics.word_statistics_a`` with its sentences and difficult words.
    """
    n, sents = stats["n"].cast("double"), (stats["sents"] if with_tools else tokens.n_sentences(text)).cast("double")
    per, syll, avg, poly = n / sents, ratio(stats["syllables"], stats["n"]), ratio(stats["len_sum"], stats["n"]), ratio(stats["poly"] * 100, stats["n"])
    hard = ratio(stats["difficult"] * 100, stats["n"]) if with_tools else poly
    out = {
        "flesch_reading_ease": F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * per - 84.6 * syll)),
        "flesch_kincaid_grade_level": 0.39 * per + 11.8 * syll - 15.59,
        "coleman_liau_index": 5.88 * avg - 29.6 * ratio(sents, stats["n"]) - 15.8,
        "gunning_fog_index": 0.4 * (per + poly),
        "smog_index": F.when(sents >= 3, 1.043 * F.sqrt(30.0 * stats["poly"] / sents) + 3.1291).otherwise(0.0),
        "dale_chall_readability_score": 0.1579 * hard + 0.0496 * per + F.when(hard > 5, 3.6365).otherwise(0.0),
    }
    short = (F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")) < 10) | (stats["n"] == 0)
    return {k: F.when(short, DEFAULTS[k]).otherwise(c) for k, c in out.items()}


def guarded(score: Column, text: Column) -> Column:
    """A score, 0 for null texts and texts of less than 10 characters."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) >= 10, score).otherwise(0.0)


def observation(text: Column) -> Column:
    return F.least(F.lit(1.0), F.length(F.coalesce(text, F.lit(""))) / F.lit(8000.0))


def clip(x: Column, low: float = 0.1, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def reward(factuality: Column, relevance: Column, flesch: Column, weights: Sequence[float] = (0.3, 0.3, 0.4)) -> Column:
    """Weighted sum; Flesch counts as its share of 100, kept in 0..1."""
    return weights[0] * factuality + weights[1] * relevance + weights[2] * (F.greatest(F.lit(0.0), F.least(F.lit(100.0), flesch)) / 100)


def valid_generation(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")) >= 10


def route(label: Column, text: Column, generated: Column) -> Column:
    """Plain texts pass through; others are replaced by what was generated for them."""
    return F.when(F.lower(label) == "pls", text).otherwise(generated)


def cap_tokens(items: Column, limit: int) -> Column:
    return F.slice(items, 1, limit)


def mask_labels(ids: Column, length: int, pad: int, prompt_length: Column | None = None, ignore: int = -100) -> Column:
    """Ids cut and padded to ``length``, with padding (and the prompt, if its length is given) set to ``ignore``."""
    padded = F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)
    skip = prompt_length if prompt_length is not None else F.lit(0)
    return F.transform(padded, lambda x, i: F.when((i >= F.size(ids)) | (i < skip), ignore).otherwise(x))
