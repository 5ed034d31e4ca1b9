"""The cleaning chain, as regular expressions in a fixed order.

The flags make Java's classes agree with Unicode-aware ones: ``U`` for ``\\w``,
``\\s`` and ``\\b``, ``d`` so that ``^`` fires after a line feed only.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.let import let

#: Pattern and replacement of each step, in the order they run.
STEPS: tuple[tuple[str, str, str], ...] = (
    ("control", r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", " "),
    ("crlf", r"\r\n", "\n"),
    ("cr", r"\r", "\n"),
    ("blank_lines", r"\n{3,}", "\n\n"),
    ("join_lines", r"([^\n])\n([^\n])", "$1 $2"),
    ("tags", r"<[^>]+>", " "),
    ("urls", r"(?iU)https?://\S+|www\.\S+", " "),
    ("emails", r"(?U)\b[\w\.-]+@[\w\.-]+\.\w+\b", " "),
    ("phones", r"(?U)\b\+?\d[\d\s\-\(\)]{6,}\d\b", " "),
    ("hashtags", r"#[A-Za-z0-9_]+", " "),
    ("markers", r"(?mdU)^[\s>*\-•·◦]+", ""),
    ("dots", r"\.{3,}", "..."),
    ("marks", r"([!?]){2,}", "$1"),
    ("space_before_mark", r"(?U)\s+([,.;:!?])", "$1"),
    # Runs of white space, and single ones other than a space; what is a space already stays.
    ("spaces", r"(?U)\s{2,}|[^\S ]", " "),
)
#: A text without any of these can't match the step's (often backtracking) pattern, so it is skipped.
NEEDS: dict[str, tuple[str, ...]] = {
    "cr": ("\r",), "crlf": ("\r",), "blank_lines": ("\n\n\n",), "join_lines": ("\n",), "tags": ("<",), "urls": ("://", "www."), "emails": ("@",),
    "hashtags": ("#",), "dots": ("...",), "marks": ("!!", "??", "!?", "?!"),
}
PATTERN = {name: pattern for name, pattern, _ in STEPS}


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def nfkc(text: Column) -> Column:
    """NFKC; Spark has no built-in, so this runs as an Arrow UDF (it is the identity on ASCII)."""
    return _nfkc(text)


def steps(text: Column, names: tuple[str, ...]) -> Column:
    """Only the named steps, in the chain's order."""
    for name, pattern, replacement in STEPS:
        if name in names:
            text = _step(text, name, pattern, replacement)
    return text


def _step(text: Column, name: str, pattern: str, replacement: str) -> Column:
    if name not in NEEDS:
        return F.regexp_replace(text, pattern, F.lit(replacement))

    def guarded(t: Column) -> Column:
        where = F.lower(t) if name == "urls" else t
        needed = reduce(lambda a, b: a | b, (F.contains(where, F.lit(n)) for n in NEEDS[name]))
        return F.when(needed, F.regexp_replace(t, pattern, F.lit(replacement))).otherwise(t)

    return let(text, guarded)


def clean(text: Column, unicode: bool = False) -> Column:
    """The whole chain; null gives "". ``unicode`` puts NFKC first."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(steps(nfkc(text) if unicode else text, tuple(PATTERN)))


@dataclass(frozen=True)
class Options:
    """Cleaning options. The last six are accepted and have no effect."""

    lowercase: bool = False
    remove_punctuation: bool = False
    normalize_whitespace: bool = True
    normalize_unicode: bool = True
    strip_html: bool = True
    replace_urls: bool = True
    replace_emails: bool = True
    deidentify_phi: bool = False
    replace_numbers: bool = False

    @classmethod
    def of(cls, values: dict[str, bool]) -> Options:
        """From a dictionary; where it has no ``lowercase``, text is lower-cased."""
        return cls(**({"lowercase": True} | {k: v for k, v in values.items() if k in cls.__dataclass_fields__}))


def normalize(text: Column, options: Options = Options(), unicode: bool = False) -> Column:  # noqa: B008
    """The chain and then the options that take effect."""
    out = clean(text, unicode)
    if options.lowercase:
        out = F.lower(out)
    if options.remove_punctuation:
        out = F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s.!?]", " "), r"(?U)\s+", " "))
    if options.normalize_whitespace:
        out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return out


def hits(text: Column, step: str) -> Column:
    """How often a step's pattern occurs."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN[step])), F.lit(0)).cast("bigint")
