"""Arrow kernels for statistics of a text's words and characters.

Spark interprets lambdas over arrays; these kernels over Arrow batches take a
half (word counts) to a third (all metrics) of their time. A kernel counts a
text's types once; all sums are then over types.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.remember import HELD, Remembered
from textloom.session import small_batches

WORD = re.compile(r"\w+")
VOWELS = re.compile("[aeiouy]+")
#: A piece between sentence ends that holds something but white space.
SENTENCE = re.compile(r"[^.!?\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][^.!?]*+")
RUN = re.compile(r"(.)\1\1+")
WORD_FIELDS = ("sents", "n", "syllables", "poly", "len_sum", "over2", "over6", "upto3", "stop", "v", "v1", "v2", "squares")
#: Superscript and subscript digits, which count as digits, and the punctuation and vowels that are counted.
RAISED = "²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
PUNCTUATION = """.,;:!?"'()-[]{}"""
VOWEL_LETTERS = "aeiouyAEIOUY"


def _kernel(run: Callable[..., pa.Array], kind: T.DataType) -> Callable[..., Column]:
    """An Arrow kernel over columns, which reads small batches whatever a partition holds."""
    of = F.arrow_udf(run, kind)

    def apply(*columns: Column) -> Column:
        small_batches()
        return of(*columns)

    return apply


def clogc(counts: Counter) -> float:
    """The sum of c log2 c over the counts, whatever their order."""
    times = Counter(counts.values())
    return math.fsum(n * c * math.log2(c) for c, n in sorted(times.items()))


def _struct(rows: list[tuple], fields: tuple[str, ...], last: str) -> pa.StructArray:
    """Rows of integers and one double."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * (len(fields) + 1)
    arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.float64())]
    return pa.StructArray.from_arrays(arrays, [*fields, last])


def _schema(fields: tuple[str, ...], last: str) -> T.StructType:
    return T.StructType([*(T.StructField(f, T.LongType()) for f in fields), T.StructField(last, T.DoubleType())])


def word_counts(stopwords: frozenset[str]) -> Callable[[Column], Column]:
    """Base counts over the sentences and words of a lower-cased text, as a struct."""

    def properties(word: str) -> tuple[int, int, int, int, int, int, int]:
        syllables, length = max(1, len(VOWELS.findall(word))), len(word)
        return syllables, syllables >= 3, length, length > 2, length > 6, length <= 3, word in stopwords

    def row(text: str, get: Remembered) -> tuple:
        types = Counter(WORD.findall(text))
        syll = poly = size = over2 = over6 = upto3 = stop = 0
        for word, c in types.items():
            s, p, length, a, b, d, e = get[word]
            syll += c * s
            size += c * length
            if p:
                poly += c
            if a:
                over2 += c
            if b:
                over6 += c
            if d:
                upto3 += c
            if e:
                stop += c
        counts = Counter(types.values())
        squares = sum(c * c * n for c, n in counts.items())
        return max(1, len(SENTENCE.findall(text))), types.total(), syll, poly, size, over2, over6, upto3, stop, len(types), counts[1], counts[2], squares, clogc(types)

    get = Remembered(properties)

    def run(texts: pa.Array) -> pa.Array:
        return _struct([row(t or "", get) for t in texts.to_pylist()], WORD_FIELDS, "clogc")

    return _kernel(run, _schema(WORD_FIELDS, "clogc"))


CHARACTER_FIELDS = ("n_letters", "n_upper", "n_lower", "n_digits", "n_punct", "n_alnum", "n_vowels", "n_nonascii")


def character_counts(single: dict[str, str]) -> Callable[[Column], Column]:
    """Counts of single characters and of classes of them, of runs of three and more of one, and their entropy in bits, as a struct."""
    fields = (*single, *CHARACTER_FIELDS, "repeat_char_runs")

    def properties(c: str) -> tuple[int, ...]:
        kind = unicodedata.category(c)
        letter, digit = kind[0] == "L", kind == "Nd" or c in RAISED
        classes = (letter, c.isupper(), c.islower(), digit, c in PUNCTUATION, letter or kind[0] == "N", c in VOWEL_LETTERS, ord(c) > 127)
        return tuple(i for i, x in enumerate((*(c == s for s in single.values()), *classes)) if x)

    def row(text: str, get: Remembered) -> tuple:
        out = [0] * len(fields)
        counts = Counter(text)
        for char, c in counts.items():
            for i in get[char]:
                out[i] += c
        out[-1] = len(RUN.findall(text))
        return (*out, math.log2(len(text)) - clogc(counts) / len(text) if text else 0.0)

    get = Remembered(properties)

    def run(texts: pa.Array) -> pa.Array:
        return _struct([row(t or "", get) for t in texts.to_pylist()], fields, "entropy")

    return _kernel(run, _schema(fields, "entropy"))


TOKEN = re.compile(r"\w+|[^\w\s]")
SENTENCE_END = re.compile(r"[.!?]+")
A_FIELDS = (
    "t", "n", "sents", "syllables", "poly", "len_sum", "len_squares", "over7", "over10", "upper", "punct", "stop", "content",
    "v", "v1", "v2", "pieces", "piece_words", "piece_squares", "difficult",
)


def vowel_runs(word: str) -> int:
    """The syllable heuristic: runs of vowels, 1 at least."""
    return max(1, len(VOWELS.findall(word)))


def plain_sentences(text: str) -> list[str]:
    """The pieces between ``.!?`` that hold something."""
    return [p for p in SENTENCE_END.split(text) if SENTENCE.search(p)]


@dataclass(frozen=True)
class Tools:
    """How tokens, sentences and syllables are found, and which words are familiar (None: those of one or two syllables).

    All are picklable callables; see ``functions.tokenizer``, ``functions.hyphenation`` and ``operators.sentences``.
    """

    tokens: Callable[[str], list[str]] = TOKEN.findall
    sentences: Callable[[str], list[str]] = plain_sentences
    syllables: Callable[[str], int] = vowel_runs
    familiar: Callable[[str], bool] | None = None


def token_counts(stopwords: frozenset[str], tools: Tools = Tools()) -> Callable[[Column], Column]:  # noqa: B008
    """Base counts over the tokens, letter-only words and sentences of a text, as a struct whose double is the median word length."""
    # A tokenizer that remembers chunks counts them without listing their tokens.
    counts = getattr(tools.tokens, "counts", lambda text: Counter(tools.tokens(text)))
    own = WORD.findall if tools.tokens == Tools.tokens else tools.tokens
    n_words = getattr(tools.tokens, "n_words", lambda piece: sum(map(str.isalpha, own(piece))))

    def properties(token: str) -> tuple:
        """(word, stop, punctuation, upper, syllables, length, lower, difficult)."""
        low, word = token.lower(), token.isalpha()
        punctuation = not token.isalnum() and all(unicodedata.category(c)[0] == "P" for c in token)
        upper = not token.islower() and any(map(str.isupper, token))
        syllables = tools.syllables(low) if word else 1
        difficult = syllables >= 3 if tools.familiar is None else not tools.familiar(low)
        return word, low in stopwords, punctuation, upper, syllables, len(token), low, difficult

    get = Remembered(properties)

    def row(text: str) -> tuple:
        tokens = counts(text)
        n = syll = poly = upper = punct = stop = content = hard = 0
        lengths: dict[int, int] = {}
        types: dict[str, int] = {}
        for token, c in tokens.items():
            word, is_stop, is_punct, is_upper, syllables, length, low, difficult = get[token]
            stop += c * is_stop
            punct += c * is_punct
            if word:
                n += c
                syll += c * syllables
                poly += c * (syllables >= 3)
                hard += c * difficult
                upper += c * is_upper
                content += c * (not is_stop)
                lengths[length] = lengths.get(length, 0) + c
                types[low] = types.get(low, 0) + c
        ordered = sorted(lengths.items())
        middles = _at(ordered, (n - 1) // 2) + _at(ordered, n // 2) if n else 0
        # Signs are no words, so the plain tokenizer needn't look for them here.
        per = [n_words(p) for p in tools.sentences(text)]
        kinds = Counter(types.values())
        size = lambda power: sum(k**power * c for k, c in ordered)
        over = lambda least: sum(c for k, c in ordered if k >= least)
        return (
            tokens.total(), n, max(1, len(per)), syll, poly, size(1), size(2), over(7), over(10), upper, punct, stop, content,
            len(types), kinds[1], kinds[2], len(per), sum(per), sum(x * x for x in per), hard, middles / 2,
        )

    def run(texts: pa.Array) -> pa.Array:
        return _struct([row(t or "") for t in texts.to_pylist()], A_FIELDS, "median")

    return _kernel(run, _schema(A_FIELDS, "median"))


def _at(ordered: list[tuple[int, int]], place: int) -> int:
    """The value at a place among values listed with their counts."""
    for value, count in ordered:
        if place < count:
            return value
        place -= count
    raise IndexError(place)


TERM = re.compile(r"\b\w\w+\b")


def terms(text: str, max_n: int) -> Counter:
    """How often the n-grams of 1..max_n of a lower-cased text's words occur."""
    words = TERM.findall(text)
    found = Counter(words)
    for n in range(2, max_n + 1):
        found.update(map(" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    return found


def term_totals(max_n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, df, total) of the n-grams of lower-cased texts, added up within a task over some HELD terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([total[t] for t in df], pa.int64())]
            df.clear()
            total.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "df", "total"])

        for batch in batches:
            for value in batch.column(0):
                found = terms(value.as_py() or "", max_n)
                df.update(found.keys())
                total.update(found)
                if len(df) >= HELD:
                    yield flush()
        if df:
            yield flush()

    return run


def term_weights(max_n: int, idf: dict[str, float]) -> Callable[[Column], Column]:
    """Array of (term, weight): L2-normalised tf-idf of a lower-cased text over the terms of ``idf``."""

    def run(texts: pa.Array) -> pa.Array:
        names, weights, ends = [], [], [0]
        for value in texts:
            x = {t: c * idf[t] for t, c in terms(value.as_py() or "", max_n).items() if t in idf}
            norm = math.sqrt(math.fsum(v * v for v in x.values()))
            names += x
            weights += [v / norm for v in x.values()]
            ends.append(len(names))
        values = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(weights, pa.float64())], ["term", "weight"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    item = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    return _kernel(run, T.ArrayType(item))


#: Runs of characters that are no white space, as Java's Unicode classes have it.
SOLID = re.compile(r"[^\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


LIGHT_FIELDS = ("tokens", "chars", "unique", "solid", "sents")


def light_counts() -> Callable[[Column], Column]:
    """White-space words, characters, types, characters of words, and sentences of a text, as a struct."""

    def row(text: str) -> tuple[int, ...]:
        words = SOLID.findall(text)
        return len(words), len(text), len(set(words)), sum(map(len, words)), len(SENTENCE.findall(text))

    def run(texts: pa.Array) -> pa.Array:
        rows = [row(t or "") for t in texts.to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(LIGHT_FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(LIGHT_FIELDS))

    return _kernel(run, T.StructType([T.StructField(f, T.LongType()) for f in LIGHT_FIELDS]))


def overlap_counts(max_n: int) -> Callable[[Column, Column], Column]:
    """Counts over the white-space words of two texts, as a struct.

    Words of either (p, r), types in both, and for n up to ``max_n`` the n-grams
    of the first text (all_n) and how many of them the second has, each as often
    as it occurs there (hit_n).
    """
    fields = ("p", "r", "types", *(f"{k}_{n}" for n in range(1, max_n + 1) for k in ("all", "hit")))

    def row(a: str, b: str) -> tuple[int, ...]:
        p, r = SOLID.findall(a), SOLID.findall(b)
        out = [len(p), len(r), 0]
        for n in range(1, max_n + 1):
            x, y = (Counter(zip(*(words[i:] for i in range(n)), strict=False)) for words in (p, r))
            hits = [min(c, y[g]) for g, c in x.items() if g in y]
            if n == 1:
                out[2] = len(hits)
            out += [max(0, len(p) - n + 1), sum(hits)]
        return tuple(out)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [row(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(fields))

    return _kernel(run, T.StructType([T.StructField(f, T.LongType()) for f in fields]))
