"""Syllables by hyphenation patterns, and familiar words with their inflections.

Both take public lists as they are distributed: one pattern (``hy3ph``) or
exception (``ta-ble``) a line, and one word a line. The lists come from a table
or a file, of a checked size, and go to the executors with the kernel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.remember import Remembered

#: Entries of a list that is sent to the executors at most, and words whose syllables a worker remembers.
ENTRIES, HELD = 1_000_000, 1 << 16
VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
#: Three consonants that begin a word together.
ONSETS = ("str", "spr", "scr", "spl", "scl", "thr", "shr", "chr", "phr", "sch")
#: Inflections: an ending, and whether a base may have lost a final e, doubled its last letter, or had a y where an i is.
ENDINGS = {"s": (False, False, False), "es": (False, False, True), "ed": (True, True, True), "ing": (True, True, False), "er": (True, True, True), "est": (True, True, True), "ly": (False, False, True)}
#: Letters that an ending leaves at least.
STEM = 2


class Hyphenation:
    """A trie of hyphenation patterns.

    A pattern's digits stand between its letters; of all patterns that lie in a
    word (``.`` is its border), the highest digit at a place counts, and an odd
    one divides. No division leaves less than ``left`` or ``right`` letters.
    """

    def __init__(self, lines: Iterable[str], left: int = 2, right: int = 2) -> None:
        self.left, self.right, self.trie, self.exceptions, self.held, self.depth = left, right, {}, {}, {}, 1
        self.windows = Remembered(self._levels)
        for line in lines:
            for entry in line.split("%")[0].split():
                self._add(entry.lower())

    def _add(self, entry: str) -> None:
        if "-" in entry:
            self.exceptions[entry.replace("-", "")] = [i - k for k, i in enumerate(i for i, c in enumerate(entry) if c == "-")]
            return
        letters, levels = [], [0]
        for c in entry:
            if c.isdigit():
                levels[-1] = int(c)
            else:
                letters.append(c)
                levels.append(0)
        node = self.trie
        for c in letters:
            node = node.setdefault(c, {})
        node[""] = levels
        self.depth = max(self.depth, len(letters))

    def _levels(self, window: str) -> tuple[tuple[int, int], ...]:
        """(place, level) of the patterns that begin where a window does."""
        found: dict[int, int] = {}
        node = self.trie
        for c in window:
            node = node.get(c)
            if node is None:
                break
            for k, level in enumerate(node.get("", ())):
                if level > found.get(k, 0):
                    found[k] = level
        return tuple(found.items())

    def points(self, word: str) -> list[int]:
        """Places where a word may be divided."""
        word = word.lower()
        if word in self.exceptions:
            return self.exceptions[word]
        whole = f".{word}."
        best, windows, depth = [0] * (len(whole) + 1), self.windows, self.depth
        for start in range(len(whole)):
            for k, level in windows[whole[start : start + depth]]:
                if level > best[start + k]:
                    best[start + k] = level
        return [i for i in range(self.left, len(word) - self.right + 1) if best[i + 1] % 2]

    def __call__(self, word: str) -> int:
        """A word's syllables."""
        found = self.held.get(word)
        if found is None:
            if len(self.held) >= HELD:
                self.held.clear()
            found = self.held[word] = len(self.points(word)) + 1
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("held", "windows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.held, self.windows = {}, Remembered(self._levels)


def rule_patterns() -> Iterator[str]:
    """Patterns by rule, where no list is at hand: a consonant goes with the vowel after it, unless it is before a silent final e."""
    for c in CONSONANTS:
        yield from (f"1{c}{v}" for v in VOWELS)
        yield f"2{c}e."
        if c not in "lr":
            yield f"3{c}le."
    yield from (f".{o[:2]}2{o[2]}" for o in ONSETS)


def bases(word: str) -> list[str]:
    """A lower-case word and what it may be a regular inflection of."""
    out = [word]
    for ending, (lost_e, doubled, y) in ENDINGS.items():
        stem = word.removesuffix(ending)
        if len(stem) == len(word) or len(stem) < STEM:
            continue
        out.append(stem)
        if lost_e:
            out.append(stem + "e")
        if doubled and stem[-1] == stem[-2]:
            out.append(stem[:-1])
        if y and stem[-1] == "i":
            out.append(stem[:-1] + "y")
    return out


class Familiar:
    """Whether a word, or what it is inflected from, is in a list."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(w.lower() for w in words)

    def __call__(self, word: str) -> bool:
        return not self.words.isdisjoint(bases(word.lower()))


def entries(lines: DataFrame, column: str | Column = "value") -> list[str]:
    """The distinct entries of a table's column, of which there may be ENTRIES."""
    found = lines.select((F.col(column) if isinstance(column, str) else column).cast("string").alias("x")).where("x is not null").distinct().limit(ENTRIES + 1).collect()
    if len(found) > ENTRIES:
        raise ValueError(f"a list of more than {ENTRIES} entries")
    return sorted(r.x for r in found)


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a list's file, in any store that Spark reads."""
    return entries(spark.read.text(path))
