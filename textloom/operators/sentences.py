"""Sentence ends learnt from the corpus, after Kiss and Strunk (2006).

A first pass counts how often each word stands with and without a full stop; a
likelihood ratio says which words are abbreviations. A second pass counts which
words follow sure sentence ends; those that do so far more often than chance
start sentences. Both sets are small (an abbreviation's score falls with its
length), checked, and go to the executors that split the texts.

Words are runs without white space, without signs that open or close. A word that
ends in ``!`` or ``?`` ends a sentence. One that ends in a stop does, unless it is
an abbreviation or an initial before a word that isn't a capitalised starter, or
a number before a lower-case word; dots do before a capitalised word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.remember import CHARACTERS, Remembered
from textloom.session import small_batches, written

#: White space, and the signs around a word.
TOKEN = re.compile(r"[^\t-\r \u00a0]+")
SPACE = "\t\n\x0b\x0c\r \u00a0"
#: A word that has one of the signs that may end a sentence.
MARKED = re.compile(r"(?<![^\t-\r \u00a0])[^\t-\r \u00a0.!?]*+[.!?][^\t-\r \u00a0]*+")
OPENERS, CLOSERS = "\"'([{<“‘«„", "\"')]}>”’»“‘"
#: Scores from which a word is an abbreviation or a starter, and the share of an abbreviation's occurrences that have a stop.
ABBREVIATION, STARTER, DOTTED = 0.3, 30.0, 0.99
#: Words of either kind at most, and counts that a task holds before it sends them on (or CHARACTERS of their words).
LIMIT, HELD = 1_000_000, 200_000


@dataclass(frozen=True)
class Word:
    """A word of a text: its place, what it is without signs, its type, and what ends it."""

    start: int
    end: int
    core: str
    type: str
    stop: bool


def _parts(token: str) -> tuple[str, str, bool]:
    """A word without signs, its type, and whether it has a stop."""
    if token.isalpha():
        return token, token.lower(), False
    core = token.lstrip(OPENERS).rstrip(CLOSERS)
    body = core.rstrip(",;:")
    return core, body.rstrip(".!?").lower(), body.endswith(".")


def _word(token: str, start: int = 0) -> Word:
    return Word(start, start + len(token), *_parts(token))


def words(text: str) -> Iterator[Word]:
    return (_word(m[0], m.start()) for m in TOKEN.finditer(text))


def is_initial(word: Word) -> bool:
    return len(word.type) == 1 and word.type.isalpha()


#: Whether a word ends a sentence: never, always, or by the word after it.
NEVER, ALWAYS, ASK = 0, 1, 2


@dataclass(frozen=True)
class Model:
    """What has been learnt; ``Model(frozenset(), frozenset())`` knows initials and numbers only."""

    abbreviations: frozenset[str]
    starters: frozenset[str]
    #: NEVER, ALWAYS or ASK of the words that have been met.
    kinds: Remembered = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "kinds", Remembered(self.kind))

    def __reduce__(self) -> tuple:
        return Model, (self.abbreviations, self.starters)

    def kind(self, token: str) -> int:
        if token.isalpha():
            return NEVER
        word = _word(token)
        if word.core.endswith(("!", "?")):
            return ALWAYS
        if not word.core.endswith("."):
            return NEVER
        open_ = word.core.endswith("..") or word.type in self.abbreviations or is_initial(word) or word.type.isdecimal()
        return ASK if open_ else ALWAYS

    def ends(self, word: Word, after: Word | None) -> bool:
        """Whether a word ends a sentence, given the one after it."""
        if after is None or word.core.endswith(("!", "?")):
            return True
        if not word.core.endswith("."):
            return False
        first = after.core[:1]
        upper = first != first.lower()
        if word.core.endswith(".."):
            return upper
        if word.type in self.abbreviations or is_initial(word):
            return upper and after.type in self.starters
        return not (word.type.isdecimal() and first != first.upper())

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the sentences of a text begin and end."""
        first = TOKEN.search(text)
        if first is None:
            return []
        out, begin = [], first.start()
        for m, after in self.asked(text):
            if self.kinds[m[0]] == ALWAYS or self.ends(_word(m[0]), _word(after[0])):
                out.append((begin, m.end()))
                begin = after.start()
        return [*out, (begin, len(text.rstrip(SPACE)))]

    def asked(self, text: str) -> Iterator[tuple[re.Match, re.Match]]:
        """The words that may end a sentence, with the words after them."""
        for m in MARKED.finditer(text):
            if self.kinds[m[0]] != NEVER:
                after = TOKEN.search(text, m.end())
                if after is not None:
                    yield m, after

    def __call__(self, text: str) -> list[str]:
        return [text[a:b] for a, b in self.spans(text)]


def _counted(df: DataFrame, text: str, of: Callable[[str], Iterable[str]], place: Callable[[bool], int], names: tuple[str, ...]) -> DataFrame:
    """(type, names): counts of the words that ``of`` gives, by the place of their name (which a stop may tell), added up within tasks first."""
    small_batches(df.sparkSession)
    schema = "type string, " + ", ".join(f"{n} bigint" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        most = 0  # characters of the held words, at most

        def flush() -> pa.RecordBatch:
            sums: dict[str, list[int]] = {}
            for token, c in held.items():
                _, kind, stop = _parts(token)
                if kind:
                    sums.setdefault(kind, [0] * len(names))[place(stop)] += c
            columns = [pa.array(list(sums), pa.string()), *(pa.array([s[i] for s in sums.values()], pa.int64()) for i in range(len(names)))]
            return pa.RecordBatch.from_arrays(columns, ["type", *names])

        for batch in batches:
            for value in batch.column(0):
                read = value.as_py() or ""
                held.update(of(read))
                most += len(read)
                full = len(held) >= HELD
                if most >= 2 * CHARACTERS:
                    most = sum(map(len, held))
                    full |= most >= CHARACTERS
                if full:
                    yield flush()
                    held, most = Counter(), 0
        if held:
            yield flush()

    return df.select(F.col(text).cast("string")).mapInArrow(run, schema).groupBy("type").agg(*(F.sum(n).alias(n) for n in names))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(type, dotted, plain): how often each word stands with a stop and without."""
    return _counted(df, text, TOKEN.findall, lambda stop: 0 if stop else 1, ("dotted", "plain"))


def abbreviation_score(words_in_all: float, dotted_in_all: float) -> Column:
    """The scaled likelihood ratio of a (type, dotted, plain) row."""
    p = min(max(dotted_in_all / max(words_in_all, 1.0), 1e-12), 1 - 1e-12)
    ratio = -2 * (F.col("dotted") * (math.log(p) - math.log(DOTTED)) + F.col("plain") * (math.log(1 - p) - math.log(1 - DOTTED)))
    letters = F.length(F.translate("type", ".", ""))
    periods = F.length("type") - letters + 1
    return ratio * F.exp(-letters) * periods * F.pow(letters.cast("double"), -F.col("plain").cast("double"))


def _log_share(share: Column, n: Column) -> Column:
    """n ln(share), 0 where n is 0."""
    return F.when(n > 0, n * F.log(F.when(n > 0, share).otherwise(1.0))).otherwise(0.0)


def starter_score(words_in_all: float, breaks: float) -> Column:
    """The likelihood ratio of standing after a sentence end, of a (type, n, after) row; negative if that is rarer than chance."""
    n, b = F.lit(words_in_all), F.lit(breaks)
    count, both = F.col("n").cast("double"), F.col("after").cast("double")
    p, p1, p2 = count / n, both / b, (count - both) / (n - b)
    same = _log_share(p, both) + _log_share(1 - p, b - both) + _log_share(p, count - both) + _log_share(1 - p, n - b - count + both)
    apart = _log_share(p1, both) + _log_share(1 - p1, b - both) + _log_share(p2, count - both) + _log_share(1 - p2, n - b - count + both)
    return F.when(p1 > p, -2 * (same - apart)).otherwise(-1.0)


def starts(model: Model) -> Callable[[str], Iterable[str]]:
    """The words after sure ends: after one with its stop that is no abbreviation, initial or number, or one that ends in ! or ?."""

    def of(text: str) -> Iterable[str]:
        return (after[0] for m, after in model.asked(text) if model.kinds[m[0]] == ALWAYS)

    return of


def _set(df: DataFrame) -> frozenset[str]:
    found = df.select("type").limit(LIMIT + 1).collect()
    if len(found) > LIMIT:
        raise ValueError(f"more than {LIMIT} words; raise the score they take")
    return frozenset(r.type for r in found)


def learn(df: DataFrame, text: str = "text") -> Model:
    """Abbreviations and starters of a corpus, in two passes over its texts.

    Defined results: null texts are empty; repeated texts count as often as they
    occur; an empty corpus teaches nothing.
    """
    counts = written(word_counts(df, text), "word-counts")
    n, dotted = counts.agg(F.sum(F.col("dotted") + F.col("plain")), F.sum("dotted")).first()
    if not n or not dotted or n == dotted:
        return Model(frozenset(), frozenset())
    abbreviations = _set(counts.where(F.col("type").rlike(r"\p{L}") & (F.col("dotted") > 0) & (abbreviation_score(n, dotted) >= ABBREVIATION)))
    after = written(_counted(df, text, starts(Model(abbreviations, frozenset())), lambda stop: 0, ("after",)), "starts")
    breaks = after.agg(F.sum("after")).first()[0] or 0
    if not 0 < breaks < n:
        return Model(abbreviations, frozenset())
    rows = counts.select("type", (F.col("dotted") + F.col("plain")).alias("n")).join(after, "type")
    return Model(abbreviations, _set(rows.where(F.col("type").rlike(r"^\p{L}") & (starter_score(float(n), float(breaks)) >= STARTER))))


def sentences(model: Model) -> Callable[[Column], Column]:
    """The sentences of a text as an array column."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    def apply(text: Column) -> Column:
        small_batches()
        return run(text)

    return apply
