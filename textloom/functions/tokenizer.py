"""A rule tokenizer: exceptions, then prefixes, suffixes and infixes peeled in turn.

White space divides a text into chunks. A chunk that is an exception (a
contraction, an abbreviation) or a URL is divided as such or kept; else an
opening sign is peeled from its front or a closing one from its end, and what is
left is tried again. What nothing can be peeled from is cut at infixes. A worker
remembers chunks it has met.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from itertools import chain

from textloom.functions.remember import Remembered

#: Signs that open and close, units that follow digits, abbreviations that keep their stop.
PREFIXES = "([{<\"'“”‘’«‹„$€£¥#&*+~§¿¡"
CLOSERS = ")]}>\"'“”‘’»›,;:!?…*%°§"
#: Closers that are peeled whatever is before them (a possessive or a unit ends in a letter).
SIGNS = frozenset(CLOSERS)
UNITS = "km km² km³ m m² m³ dm cm mm µm μm nm kg g mg µg μg ng t lb oz l dl cl ml h min s ms Hz kHz MHz GHz kB MB GB TB kb Mb Gb Tb kPa Pa mbar mmHg kcal cal J kJ K °C °F mmol IU".split()
ABBREVIATIONS = "dr. mr. mrs. ms. prof. st. jr. sr. vs. etc. e.g. i.e. cf. al. fig. no. vol. inc. ltd. co. approx. dept. est. a.m. p.m.".split()
#: Contractions: pronouns and auxiliaries with what may follow them.
PRONOUNS = "i you he she it we they who what that there here where when how why".split()
ENDINGS = ("'m", "'re", "'s", "'ve", "'ll", "'d")
NEGATED = "do does did is are was were have has had would could should might must need ought".split()
IRREGULAR = {"can't": ("ca", "n't"), "cannot": ("can", "not"), "won't": ("wo", "n't"), "shan't": ("sha", "n't"), "ain't": ("ai", "n't"), "let's": ("let", "'s"), "gonna": ("gon", "na"), "gotta": ("got", "ta")}

URL = re.compile(r"(?:https?://|www\.)[^\s<>\"']*[^\s<>\"'.,;:!?)\]}]|[\w.+-]+@\w[\w-]*(?:\.\w[\w-]*)+", re.I)
#: A number and the unit after it, a possessive, dots at the end.
UNIT = re.compile(rf"(?<=\d)(?:{'|'.join(map(re.escape, sorted(UNITS, key=len, reverse=True)))})$")
POSSESSIVE = re.compile(r"(?<=\w)['’][sS]$")
DOTS = re.compile(r"\.{2,}$")
#: A stop ends a chunk of lower-case letters or digits, of two capitals or more, or one after a closing sign.
STOP = re.compile(r"(?:(?<=[^\W\d_A-Z])|(?<=\d)|(?<=[A-Z][A-Z])|(?<=[)\]}\"'”’%°]))\.$")
LETTER = r"[^\W\d_]"
INFIX = re.compile(rf"\.{{2,}}|…|[—–]|--+|(?<={LETTER})[-~](?={LETTER})|(?<=\w)[:<>=/](?={LETTER})|(?<={LETTER}),(?={LETTER})|(?<=[a-z])\.(?=[A-Z])|(?<=\d)[+*^](?=\d)|[()\[\]{{}}\"“”]")


def contractions() -> dict[str, tuple[str, ...]]:
    """Chunks in lower case, with the parts they are divided into."""
    out = {p + e: (p, e) for p in PRONOUNS for e in ENDINGS} | {v + "n't": (v, "n't") for v in NEGATED} | IRREGULAR
    return out | {k.replace("'", "’"): tuple(x.replace("'", "’") for x in v) for k, v in out.items()}


class Tokenizer:
    """``Tokenizer()(text)`` is the list of a text's tokens; ``exceptions`` are further chunks that are kept whole."""

    def __init__(self, exceptions: Iterable[str] = ABBREVIATIONS) -> None:
        self.exceptions = contractions() | {x.lower(): (x,) for x in exceptions}
        self._remember()

    def _remember(self) -> None:
        self.held = Remembered(self._known)

    def _known(self, chunk: str) -> tuple[list[str], int]:
        """A chunk's tokens, and how many of them are letters only."""
        tokens = self.divide(chunk)
        return tokens, sum(map(str.isalpha, tokens))

    def __getstate__(self) -> dict:
        return {"exceptions": self.exceptions}

    def __setstate__(self, state: dict) -> None:
        self.exceptions = state["exceptions"]
        self._remember()

    def __call__(self, text: str) -> list[str]:
        return list(chain.from_iterable([self.held[chunk][0] for chunk in text.split()]))

    def counts(self, text: str) -> Counter:
        """How often each token of a text occurs."""
        out: Counter = Counter()
        held, get = self.held, out.get
        for chunk, c in Counter(text.split()).items():
            for token in held[chunk][0]:
                out[token] = get(token, 0) + c
        return out

    def n_words(self, text: str) -> int:
        """Tokens of letters only."""
        held = self.held
        return sum([held[chunk][1] for chunk in text.split()])

    def divide(self, chunk: str) -> list[str]:
        # Letters alone, with a sign after them or not, are most chunks.
        if chunk.isalpha() and chunk.lower() not in self.exceptions:
            return [chunk]
        if chunk[:-1].isalpha() and (chunk[-1] in SIGNS or chunk[-1] == "." and not "A" <= chunk[-2] <= "Z") and chunk.lower() not in self.exceptions:
            return [*self.divide(chunk[:-1]), chunk[-1]]
        front: list[str] = []
        back: list[str] = []
        while chunk:
            parts = self.exceptions.get(chunk.lower())
            if parts:
                ends = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
                front += [chunk[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                break
            if URL.fullmatch(chunk):
                front.append(chunk)
                break
            if len(chunk) == 1:
                front.append(chunk)
                break
            if chunk[0] in PREFIXES:
                front.append(chunk[0])
                chunk = chunk[1:]
                continue
            size = self._suffix(chunk)
            if size:
                back.append(chunk[-size:])
                chunk = chunk[:-size]
                continue
            front += self._infixes(chunk)
            break
        return front + back[::-1]

    @staticmethod
    def _suffix(chunk: str) -> int:
        """The length of what is peeled from the end, less than all of it."""
        for pattern in (POSSESSIVE, UNIT, DOTS, STOP):
            m = pattern.search(chunk)
            if m and m.start():
                return len(chunk) - m.start()
        return 1 if chunk[-1] in CLOSERS else 0

    @staticmethod
    def _infixes(chunk: str) -> list[str]:
        out, at = [], 0
        for m in INFIX.finditer(chunk):
            out += [x for x in (chunk[at : m.start()], m[0]) if x]
            at = m.end()
        return out + [chunk[at:]] * (at < len(chunk))
