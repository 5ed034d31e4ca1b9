"""Text metrics of a row, without a shuffle.

Words and characters are counted once a text by Arrow kernels, each of which
gives one struct; the columns are expressions over its fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import kernels, tokens
from textloom.functions.cleaning import PATTERN
from textloom.functions.let import let, ratio
from textloom.schemas import replace_columns

#: English stop words.
STOPWORDS = """
a about above after again against all am an and any are aren as at be because been before being
below between both but by can cannot could couldn did didn do does doesn doing don down during each
few for from further had hadn has hasn have haven having he her here hers herself him himself his how
i if in into is isn it its itself let me more most mustn my myself no nor not of off on once only or
other our ours ourselves out over own same shan she should shouldn so some such than that the their
theirs them themselves then there these they this those through to too under until up very was wasn we
were weren what when where which while who whom why with won would wouldn you your yours yourself yourselves
""".split()

READABILITY = ("flesch", "fk", "fog", "smog", "cli", "ari", "dale", "words_per_sent", "chars_per_sent")
LEXICAL = (
    "type_token_ratio", "hapax_ratio", "dislegomena_ratio", "unique_words", "guiraud_r", "herdan_c", "dugast_u", "sichel_s",
    "brunet_w", "honore_r", "maas_ttr", "yule_k", "simpson_d", "entropy_words", "stopword_ratio", "long_word_ratio", "short_word_ratio",
)
#: Characters that are counted alone.
SINGLE = {
    "n_spaces": " ", "n_tabs": "\t", "n_newlines": "\n", "n_periods": ".", "n_commas": ",", "n_semicolons": ";", "n_colons": ":",
    "n_exclaims": "!", "n_questions": "?", "hashtags": "#", "atsigns": "@",
}
PATTERNS = {"urls": PATTERN["urls"], "emails": PATTERN["emails"]}
_WORD_COUNTS, _TOKEN_COUNTS = kernels.word_counts(frozenset(STOPWORDS)), kernels.token_counts(frozenset(STOPWORDS))
_CHARACTER_COUNTS = kernels.character_counts(SINGLE)


def _log(x: Column) -> Column:
    """ln x, 0 where x isn't above 0."""
    return F.when(x > 0, F.log(F.when(x > 0, x))).otherwise(0.0)


def run_lengths(tokens: Column) -> Column:
    """Lengths of the runs of equal items in the sorted array: the frequencies of its types, in their order."""

    def of(sorted_tokens: Column) -> Column:
        n = F.size(sorted_tokens)
        places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        ends = F.filter(places, lambda i: (i == n) | (F.get(sorted_tokens, i - 1) != F.get(sorted_tokens, i)))
        lengths = let(ends, lambda e: F.transform(e, lambda x, k: x - F.when(k > 0, F.get(e, k - 1)).otherwise(0)))
        return F.when(n > 0, lengths).otherwise(F.array().cast("array<int>"))

    return let(F.array_sort(tokens), of)


def word_statistics(text: Column) -> Column:
    """Struct of base counts over the words of a text.

    sents (1 at least), n, syllables, poly (3+ syllables), len_sum, over2, over6, upto3, stop, v, v1,
    v2, squares (of frequencies) and clogc (frequency times its log2).
    """
    return _WORD_COUNTS(F.lower(F.coalesce(text, F.lit(""))))


def readability(s: Column, text: Column) -> dict[str, Column]:
    """Readability columns from word statistics; null without words."""
    n, sents = s["n"].cast("double"), s["sents"].cast("double")
    per, avg = n / sents, ratio(s["len_sum"], s["n"])
    syll, long, over2 = ratio(s["syllables"], s["n"]), ratio(s["over6"] * 100, s["n"]), ratio(s["over2"] * 100, s["n"])
    chars = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), tokens.SENTENCE_END, ""))
    out = {
        "flesch": 206.835 - 1.015 * per - 84.6 * syll,
        "fk": 0.39 * per + 11.8 * syll - 15.59,
        "fog": 0.4 * (per + long),
        "smog": F.when(s["poly"] > 0, 1.0430 * F.sqrt(30.0 * s["poly"] / sents) + 3.1291).otherwise(0.0),
        "cli": 5.89 * avg - 0.3 * ratio(sents, s["n"]) - 15.8,
        "ari": 4.71 * avg + 0.5 * per - 21.43,
        "dale": 64 - 0.95 * over2,
        "words_per_sent": per,
        "chars_per_sent": chars / sents,
    }
    return {k: F.when(s["n"] > 0, c) for k, c in out.items()}


def lexical(s: Column) -> dict[str, Column]:
    """Lexical diversity from word statistics; null without words."""
    n, v = s["n"].cast("double"), s["v"].cast("double")
    ln_n, ln_v = _log(n), _log(v)
    many = (s["n"] > 1) & (s["v"] > 1)
    out = {
        "type_token_ratio": ratio(v, n),
        "hapax_ratio": ratio(s["v1"], n),
        "dislegomena_ratio": ratio(s["v2"], n),
        "unique_words": s["v"],
        "guiraud_r": ratio(v, F.sqrt(n)),
        "herdan_c": F.when(many, ratio(ln_v, ln_n)).otherwise(0.0),
        "dugast_u": F.when(many & (s["v"] < s["n"]), ratio(ln_n * ln_n, ln_n - ln_v)).otherwise(0.0),
        "sichel_s": ratio(s["v2"], v),
        "brunet_w": F.pow(n, -F.pow(v, F.lit(-0.165))),
        "honore_r": F.when(s["v1"] < s["v"], 100 * ln_n / F.when(s["v1"] < s["v"], 1 - s["v1"] / v)).otherwise(0.0),
        "maas_ttr": F.when(many, ratio(ln_n - ln_v, ln_n * ln_n)).otherwise(0.0),
        "yule_k": ratio((s["squares"] - s["n"]) * 1e4, n * n),
        "simpson_d": ratio(s["squares"], n * n),
        "entropy_words": F.log2(n) - ratio(s["clogc"], n),
        "stopword_ratio": ratio(s["stop"], n),
        "long_word_ratio": ratio(s["over6"], n),
        "short_word_ratio": ratio(s["upto3"], n),
    }
    return {k: F.when(s["n"] > 0, c) for k, c in out.items()}


def character_statistics(text: Column) -> Column:
    """Struct of the character counts that ``characters`` reads, and their entropy."""
    return _CHARACTER_COUNTS(F.coalesce(text, F.lit("")))


def character_entropy(text: Column) -> Column:
    """Entropy of the characters in bits."""
    return character_statistics(text)["entropy"]


def characters(text: Column) -> dict[str, Column]:
    """Character counts and ratios."""
    text = F.coalesce(text, F.lit(""))
    held = character_statistics(text)
    count = {"n_chars": F.length(text)} | {k: held[k] for k in (*SINGLE, *kernels.CHARACTER_FIELDS)}
    count["n_alpha"] = count["n_letters"]
    count |= {k: F.regexp_count(text, F.lit(p)) for k, p in PATTERNS.items()} | {"repeat_char_runs": held["repeat_char_runs"]}
    # The pattern backtracks in every word, so texts without the sign skip it.
    count["emails"] = F.when(F.contains(text, F.lit("@")), count["emails"]).otherwise(0)
    count = {k: c.cast("bigint") for k, c in count.items()}
    count["n_consonants"] = F.greatest(F.lit(0).cast("bigint"), count["n_letters"] - count["n_vowels"])
    n, letters = F.greatest(count["n_chars"], F.lit(1)), count["n_letters"]
    shares = {
        "digit_ratio": "n_digits", "punct_ratio": "n_punct", "upper_ratio": "n_upper", "lower_ratio": "n_lower", "space_ratio": "n_spaces",
        "non_ascii_ratio": "n_nonascii", "urls_ratio": "urls", "emails_ratio": "emails",
    }
    return (
        count
        | {k: ratio(count[c], n) for k, c in shares.items()}
        | {"vowel_ratio": ratio(count["n_vowels"], letters), "consonant_ratio": ratio(count["n_consonants"], letters)}
        | {"entropy_chars": held["entropy"]}
    )


def surface(s: Column, text: Column, n_tokens: Column | None = None) -> dict[str, Column]:
    """Token, word and sentence counts; ``n_tokens`` defaults to white-space words."""
    n_tokens = tokens.n_white_words(text) if n_tokens is None else n_tokens.cast("bigint")
    return {
        "n_tokens": n_tokens,
        "avg_tok_len": ratio(F.length(F.coalesce(text, F.lit(""))), n_tokens),
        "avg_word_len": ratio(s["len_sum"], s["n"]),
        "n_words": s["n"],
        "n_sents": s["sents"],
    }


def family_b(text: Column, s: Column, n_tokens: Column | None = None) -> dict[str, Column]:
    """All columns of the regex-only family."""
    return surface(s, text, n_tokens) | readability(s, text) | lexical(s) | characters(text)


def word_statistics_a(text: Column, tools: kernels.Tools | None = None) -> Column:
    """Struct of base counts over tokens, for ``family_a``; regex tokens and heuristics without ``tools``."""
    counts = kernels.token_counts(frozenset(STOPWORDS), tools) if tools else _TOKEN_COUNTS
    return counts(F.coalesce(text, F.lit("")))


def _deviation(n: Column, total: Column, squares: Column) -> Column:
    """The standard deviation of n integers, 0 if there is one at most."""
    mean = ratio(total, n)
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), ratio(squares, n) - mean * mean))).otherwise(0.0)


def family_a(text: Column, s: Column) -> dict[str, Column]:
    """The 37 columns of the tagger-based family, from ``word_statistics_a``.

    Without ``kernels.Tools``, tokens are ``\\w+`` or single other characters,
    sentences the pieces between ``.!?``, syllables runs of vowels, and words of
    three syllables or more difficult. Words are tokens of letters only. The seven
    readability columns follow the published formulas. Part-of-speech ratios are
    null without a tagger (see ``operators.plugins``).
    """
    text = F.coalesce(text, F.lit(""))
    n, sents = s["n"], s["sents"]
    per_word = lambda c, times=1: ratio(s[c] * times, n)
    w_s, y_w, l_w, p_w, d_w = ratio(n, sents), per_word("syllables"), per_word("len_sum"), per_word("poly", 100), per_word("difficult", 100)
    columns = {
        "n_words": n, "n_sents": sents, "avg_word_len": l_w, "median_word_len": s["median"], "std_word_len": _deviation(n, s["len_sum"], s["len_squares"]),
        "avg_sent_len_words": ratio(s["piece_words"], s["pieces"]), "std_sent_len_words": _deviation(s["pieces"], s["piece_words"], s["piece_squares"]),
        "ttr": per_word("v"), "root_ttr": ratio(s["v"], F.sqrt(n.cast("double"))),
        "log_ttr": F.when(n > 1, ratio(F.log(s["v"] + F.lit(1.0)), F.log(n + F.lit(1.0)))).otherwise(0.0), "hapax_ratio": per_word("v1"), "hapax_dis_ratio": per_word("v2"),
        "prop_long_words_7": per_word("over7"), "prop_long_words_10": per_word("over10"), "prop_uppercase_words": per_word("upper"),
        "prop_punct_tokens": ratio(s["punct"], s["t"]), "prop_stop_tokens": ratio(s["stop"], s["t"]), "lexical_density": per_word("content"),
    }
    scores = {
        "flesch_reading_ease": 206.835 - 1.015 * w_s - 84.6 * y_w,
        "flesch_kincaid_grade": 0.39 * w_s + 11.8 * y_w - 15.59,
        "gunning_fog": 0.4 * (w_s + p_w),
        "smog_index": F.when(sents >= 3, 1.043 * F.sqrt(30.0 * s["poly"] / sents) + 3.1291).otherwise(0.0),
        "coleman_liau_index": 5.88 * l_w - 29.6 * ratio(sents, n) - 15.8,
        "automated_readability_index": 4.71 * l_w + 0.5 * w_s - 21.43,
        "dale_chall": 0.1579 * d_w + 0.0496 * w_s + F.when(d_w > 5, 3.6365).otherwise(0.0),
        "lix": w_s + per_word("over7", 100),
        "rix": ratio(s["over7"], sents),
    }
    tags = {f"{t}_ratio": F.lit(None).cast("double") for t in ("noun", "verb", "adj", "adv", "pron", "propn", "num")}
    zeroed = {k: F.when(n > 0, x).otherwise(F.lit(0).cast("bigint") if k.startswith("n_") else F.lit(0.0)) for k, x in (columns | scores).items()}
    kept = {"n_tokens": s["t"], "n_chars": F.length(text).cast("bigint"), "n_chars_nospace": F.length(F.replace(text, F.lit(" "), F.lit(""))).cast("bigint")}
    order = (*columns, *tags, *scores)
    return kept | {k: (zeroed | tags)[k] for k in order}


def with_metrics(df: DataFrame, text_col: str, wanted: Sequence[str] | None = None, keep: Sequence[str] = (), tokens_col: str | None = None) -> DataFrame:
    """``keep`` and the wanted columns of family B (all if None)."""
    held = df.withColumn("__words", word_statistics(F.col(text_col)))
    columns = family_b(F.col(text_col), F.col("__words"), F.col(tokens_col) if tokens_col else None)
    return held.select(*keep, *(columns[k].alias(k) for k in (wanted or columns)))


def metrics_batch(df: DataFrame, text_col: str = "chunk_text", label_col: str = "label", id_col: str = "document_id") -> DataFrame:
    """The whole of family B by row, with id and label; a ``tokens`` column gives n_tokens."""
    columns = [c for c in (id_col, label_col) if c in df.columns]
    return with_metrics(df, text_col, keep=columns, tokens_col="tokens" if "tokens" in df.columns else None)


def metrics_a(df: DataFrame, text_col: str = "text", tools: kernels.Tools | None = None) -> DataFrame:
    """``df`` with family A, whose columns replace those of the same name."""
    columns = family_a(F.col("__text"), F.col("__words"))
    held = replace_columns(df.withColumns({"__text": F.col(text_col), "__words": word_statistics_a(F.col(text_col), tools)}), list(columns))
    return held.select(*(c for c in held.columns if c not in ("__text", "__words")), *(x.alias(k) for k, x in columns.items()))
