"""Tables and SQL fragments that the registered queries share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.cleaning import PATTERN, STEPS
from textloom.functions.labels import label_name
from textloom.functions.metrics import STOPWORDS

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with their SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def take(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh() -> str:
    """A name that no other run uses."""
    return uuid.uuid4().hex


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a label, as ``pls`` (quality 1) or ``no_pls`` (quality 0)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", label_name(F.col("quality")).alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id")


def rounded(columns: dict[str, Column], digits: int = 6) -> list[Column]:
    """Columns under their names, doubles rounded by a cast-free rule: bigint columns start with ``n_`` or are counts."""
    return [F.round(c, digits).alias(k) for k, c in columns.items()]


LABELLED = "(SELECT d.*, CASE l.quality WHEN 1 THEN 'pls' WHEN 0 THEN 'no_pls' END AS label FROM documents d JOIN labels l USING (doc_id))"


def _re2(pattern: str) -> str:
    """A cleaning pattern without the flags that only Java has."""
    flags, rest = re.fullmatch(r"(?:\(\?([a-zA-Z]+)\))?(.*)", pattern, re.S).groups()
    kept = "".join(f for f in flags or "" if f in "im")
    return f"(?{kept}){rest}" if kept else rest


def _replacement(text: str) -> str:
    """A cleaning replacement as an SQL expression."""
    quoted = re.sub(r"\$(\d)", r"\\\1", text)
    return " || ".join(["chr(10)"] * len(text)) if text and not text.strip("\n") else f"'{quoted}'"


#: The cleaning steps in RE2's syntax: pattern, replacement.
_STEPS = [(_re2(pattern), _replacement(replacement)) for _, pattern, replacement in STEPS]


def sql_steps(text: str, first: int = 0, last: int = len(_STEPS)) -> str:
    for pattern, replacement in _STEPS[first:last]:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return text


def sql_clean(text: str = "text") -> str:
    return f"trim({sql_steps(f'coalesce({text}, $$$$)')})"


def white(text: str) -> str:
    """SQL list of white-space words."""
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"


def n_sents(text: str) -> str:
    return rf"greatest(1, len(regexp_extract_all({text}, '[^.!?\s][^.!?]*')))"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def stats(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """SQL of the word statistics: a row per document, with sents and the text."""
    return rf"""
    SELECT d.*, coalesce(n, 0) AS n, coalesce(syl, 0) AS syl, coalesce(poly, 0) AS poly, coalesce(lens, 0) AS lens, coalesce(over2, 0) AS over2,
           coalesce(over6, 0) AS over6, coalesce(upto3, 0) AS upto3, coalesce(stop, 0) AS stop, coalesce(v, 0) AS v, coalesce(v1, 0) AS v1,
           coalesce(v2, 0) AS v2, coalesce(squares, 0) AS squares, coalesce(clogc, 0) AS clogc, {n_sents(f"d.{text}")}::DOUBLE AS sents
    FROM {source} d LEFT JOIN (
        SELECT {key}, sum(c)::DOUBLE AS n, sum(c * s)::DOUBLE AS syl, sum(CASE WHEN s >= 3 THEN c ELSE 0 END)::DOUBLE AS poly, sum(c * length(w))::DOUBLE AS lens,
               sum(CASE WHEN length(w) > 2 THEN c ELSE 0 END)::DOUBLE AS over2, sum(CASE WHEN length(w) > 6 THEN c ELSE 0 END)::DOUBLE AS over6,
               sum(CASE WHEN length(w) <= 3 THEN c ELSE 0 END)::DOUBLE AS upto3, sum(CASE WHEN w IN ({_STOP}) THEN c ELSE 0 END)::DOUBLE AS stop,
               count(*)::DOUBLE AS v, count(*) FILTER (c = 1)::DOUBLE AS v1, count(*) FILTER (c = 2)::DOUBLE AS v2, sum(c * c)::DOUBLE AS squares, sum(c * log2(c)) AS clogc
        FROM (SELECT {key}, w, count(*) AS c, greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))) AS s
              FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')) AS w FROM {source}) GROUP BY ALL)
        GROUP BY {key}) USING ({key})"""


#: SQL of the readability columns over ``stats``.
READABILITY = {
    "flesch": "206.835 - 1.015 * (n / sents) - 84.6 * (syl / n)",
    "fk": "0.39 * (n / sents) + 11.8 * (syl / n) - 15.59",
    "fog": "0.4 * (n / sents + 100 * over6 / n)",
    "smog": "CASE WHEN poly > 0 THEN 1.0430 * sqrt(30.0 * poly / sents) + 3.1291 ELSE 0.0 END",
    "cli": "5.89 * (lens / n) - 0.3 * (sents / n) - 15.8",
    "ari": "4.71 * (lens / n) + 0.5 * (n / sents) - 21.43",
    "dale": "64 - 0.95 * (100 * over2 / n)",
    "words_per_sent": "n / sents",
    "chars_per_sent": "length(regexp_replace(text, '[.!?]+', '', 'g')) / sents",
}
LEXICAL = {
    "type_token_ratio": "v / n",
    "hapax_ratio": "v1 / n",
    "dislegomena_ratio": "v2 / n",
    "unique_words": "v",
    "guiraud_r": "v / sqrt(n)",
    "herdan_c": "CASE WHEN n > 1 AND v > 1 THEN ln(v) / ln(n) ELSE 0 END",
    "dugast_u": "CASE WHEN n > 1 AND v > 1 AND v < n THEN ln(n) * ln(n) / (ln(n) - ln(v)) ELSE 0 END",
    "sichel_s": "v2 / v",
    "brunet_w": "pow(n, -pow(v, -0.165))",
    "honore_r": "CASE WHEN v1 < v THEN 100 * ln(n) / (1 - v1 / v) ELSE 0 END",
    "maas_ttr": "CASE WHEN n > 1 AND v > 1 THEN (ln(n) - ln(v)) / (ln(n) * ln(n)) ELSE 0 END",
    "yule_k": "1e4 * (squares - n) / (n * n)",
    "simpson_d": "squares / (n * n)",
    "entropy_words": "log2(n) - clogc / n",
    "stopword_ratio": "stop / n",
    "long_word_ratio": "over6 / n",
    "short_word_ratio": "upto3 / n",
}
#: What each character count counts, in RE2's syntax.
_COUNTS = {
    "n_chars": "length(text)", "n_letters": r"\p{L}", "n_upper": r"\p{Lu}", "n_lower": r"[\p{Ll}ªº]", "n_digits": r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]", "n_spaces": " ",
    "n_tabs": r"\t", "n_newlines": r"\n", "n_punct": r"""[.,;:!?"''()\-\[\]{}]""", "n_nonascii": r"[^\x00-\x7F]", "n_alpha": r"\p{L}", "n_alnum": r"[\p{L}\p{N}]",
    "n_vowels": "[aeiouyAEIOUY]", "n_periods": r"\.", "n_commas": ",", "n_semicolons": ";", "n_colons": ":", "n_exclaims": "!", "n_questions": r"\?",
    "hashtags": "#", "atsigns": "@", "urls": _re2(PATTERN["urls"]), "emails": _re2(PATTERN["emails"]),
}
CHARACTERS = {k: p if k == "n_chars" else f"len(regexp_extract_all(text, '{p}'))" for k, p in _COUNTS.items()}
CHARACTERS["n_consonants"] = f"greatest(0, {CHARACTERS['n_letters']} - {CHARACTERS['n_vowels']})"
SHARES = {
    "digit_ratio": "n_digits / greatest(1, n_chars)", "punct_ratio": "n_punct / greatest(1, n_chars)", "upper_ratio": "n_upper / greatest(1, n_chars)",
    "lower_ratio": "n_lower / greatest(1, n_chars)", "space_ratio": "n_spaces / greatest(1, n_chars)", "non_ascii_ratio": "n_nonascii / greatest(1, n_chars)",
    "urls_ratio": "urls / greatest(1, n_chars)", "emails_ratio": "emails / greatest(1, n_chars)",
    "vowel_ratio": "CASE WHEN n_letters > 0 THEN n_vowels / n_letters ELSE 0 END", "consonant_ratio": "CASE WHEN n_letters > 0 THEN n_consonants / n_letters ELSE 0 END",
}
CHAR_ENTROPY = """(SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy_chars FROM (
    SELECT doc_id, ch, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL) GROUP BY doc_id)"""


def select(columns: dict[str, str], names=None, guard: str = "n > 0", digits: int = 6) -> str:
    """SQL of the named columns as rounded doubles, null unless the guard holds."""
    return ", ".join(f"CASE WHEN {guard} THEN round(({columns[k]})::DOUBLE, {digits}) END AS {k}" for k in names or columns)


def whole(columns: dict[str, str], names=None) -> str:
    return ", ".join(f"({columns[k]})::BIGINT AS {k}" for k in names or columns)
