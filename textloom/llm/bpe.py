"""Byte-pair encoding and decoding with a public word-level vocabulary.

A text is cut at the special tokens' strings, normalised (NFC, lower case a
character at a time) and split into words; every word's UTF-8 bytes are merged
by rank and end in a part that carries the end-of-word mark.

A short word is held as one contiguous array of part boundaries and one of the
ranks of adjacent parts: the least rank is scanned for, its boundary deleted,
and the two neighbouring ranks looked up again. A scan costs the word's length,
so a word of more than ``SHORT`` bytes takes the same merges from a heap over
linked boundaries instead; both give the same parts.

The vocabulary file is a parameter. The driver reads it once and broadcasts its
bytes, whose size is checked (``VOCABULARY_BYTES``), so executors need no file.

Defined results: a null text is empty and an empty text has no ids; a text is
encoded whole, however long, as is a word; of equal ranks the leftmost is merged
first; repeated rows keep a row each; an empty table gives no rows. Columns of
the input are read by name into new names, so its other columns can't clash.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the vocabulary's format: how words are found, the mark of a word's last part, bytes written as themselves.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))

#: The end-of-word mark inside this module: a character above all bytes.
END = "Ā"
#: Bytes of a word up to which its ranks are scanned.
SHORT = 96
#: Words whose ids a worker remembers: up to twice as many, as those in use outlive the others.
MEMO = 300_000
#: Bytes of a vocabulary file that are broadcast at most.
VOCABULARY_BYTES = 64 << 20
#: Bytes of ids and text in one batch of results, about.
BATCH_BYTES = 8 << 20
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable ones stand for themselves, the others follow from U+0100."""
    letters = {chr(b): b for b in PRINTABLE}
    hidden = [b for b in range(256) if b not in PRINTABLE]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo(dict):
    """Ids by word. When full, it starts anew, but what is asked for again is taken over from before."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        self[word] = found
        return found


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, body: bytes) -> None:
        file = json.loads(body)
        model = file["model"]
        letters = byte_letters()

        def plain(token: str) -> str:
            """A token with a character a byte, and END for the mark."""
            stem = token.removesuffix(WORD_END)
            return "".join(chr(letters[c]) for c in stem) + (END if len(stem) < len(token) else "")

        self.ids = {plain(token): i for token, i in model["vocab"].items()}
        self.ranks = {(plain(a), plain(b)): rank for rank, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = dict(enumerate(sorted(model["vocab"], key=model["vocab"].get))) | {i: t for t, i in self.special.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self._words = regex.compile(WORDS)
        self._memo = Memo(self.word)

    def parts(self, symbols: str) -> list[str]:
        """The merged parts of a word, given with a character a byte and END at its end."""
        size = len(symbols) - symbols.endswith(END)
        bounds = [*range(size), len(symbols)]
        merged = _scanned if size <= SHORT else _heaped
        return [symbols[a:b] for a, b in pairwise(merged(symbols, bounds, self.ranks))]

    def word(self, word: str) -> bytes:
        """A word's ids, as they are written: little-endian unsigned 32-bit integers."""
        ids = [self.ids[p] for p in self.parts(word.encode().decode("latin-1") + END)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """A text's ids, as ``word`` writes them."""
        out, at = [], 0
        for hit in self._special.finditer(text or ""):
            out += self._segment(text[at : hit.start()])
            out.append(struct.pack("<I", self.special[hit[0]]))
            at = hit.end()
        out += self._segment(text[at:] if text else "")
        return b"".join(out)

    def _segment(self, text: str) -> Iterator[bytes]:
        if not text.isascii():
            # Capital sigma apart: its lower case doesn't depend on its place here.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return map(self._memo.__getitem__, self._words.findall(text.lower()))

    def decode(self, ids: bytes) -> str:
        """The tokens of ``encode``'s ids, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def _scanned(symbols: str, bounds: list[int], ranks: dict[tuple[str, str], int]) -> list[int]:
    """The boundaries that are left after all merges, by scans of the array of adjacent ranks."""

    get = ranks.get
    single = [*symbols[: bounds[-2]], symbols[bounds[-2] :]]
    adjacent = [get(pair, NEVER) for pair in pairwise(single)]
    while adjacent and (least := min(adjacent)) != NEVER:
        i = adjacent.index(least)
        del bounds[i + 1], adjacent[i]
        a, b = bounds[i], bounds[i + 1]
        merged = symbols[a:b]
        if i:
            adjacent[i - 1] = get((symbols[bounds[i - 1] : a], merged), NEVER)
        if i < len(adjacent):
            adjacent[i] = get((merged, symbols[b : bounds[i + 2]]), NEVER)
    return bounds


def _heaped(symbols: str, bounds: list[int], ranks: dict[tuple[str, str], int]) -> list[int]:
    """As ``_scanned``, with ranks in a heap; entries whose parts have changed since are passed over."""
    after = dict(pairwise(bounds))
    before = {b: a for a, b in after.items()}

    def entry(a: int) -> tuple[int, int, int, int] | None:
        """Rank, start, boundary and end of the pair of parts that starts at a."""
        b = after.get(a)
        c = after.get(b)
        if c is None:
            return None
        rank = ranks.get((symbols[a:b], symbols[b:c]))
        return None if rank is None else (rank, a, b, c)

    heap = [e for e in map(entry, bounds[:-2]) if e]
    heapify(heap)
    while heap:
        _, a, b, c = heappop(heap)
        if after.get(a) != b or after.get(b) != c:
            continue
        after[a], before[c] = c, a
        del after[b], before[b]
        for start in (before.get(a), a):
            if start is not None and (e := entry(start)):
                heappush(heap, e)
    return [*sorted(after), bounds[-1]]


@lru_cache(2)
def _parsed(body: bytes) -> Vocabulary:
    """The worker's vocabulary, with its memory of words."""
    return Vocabulary(body)


def _broadcast(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        body = file.read(VOCABULARY_BYTES + 1)
    if len(body) > VOCABULARY_BYTES:
        raise ValueError(f"{path} holds more than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(body)


def _mapped(df: DataFrame, path: str, schema: str, row) -> DataFrame:
    """``row(vocabulary, value)``'s fields behind each row's key; ``df`` is (key, value)."""
    shared = _broadcast(df.sparkSession, path)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _parsed(shared.value)
        for batch in batches:
            first, size, columns = 0, 0, []
            for at, value in enumerate(batch.column(1), 1):
                columns.append(row(vocabulary, value.as_py()))
                size += sum(map(len, columns[-1]))
                if size >= BATCH_BYTES or at == len(batch):
                    keys = batch.column(0).slice(first, at - first)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c) for c in zip(*columns, strict=True))], names)
                    first, size, columns = at, 0, []

    return df.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) and, if asked for, (decoded): ids as a binary string of little-endian unsigned 32-bit integers."""
    schema = "doc_id bigint, ids binary" + ", decoded string" * decoded

    def row(vocabulary: Vocabulary, text: str | None) -> tuple:
        ids = vocabulary.encode(text)
        return (ids, vocabulary.decode(ids)) if decoded else (ids,)

    return _mapped(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), path, schema, row)


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of ``encoded``'s rows."""
    return _mapped(tokens.select(F.col(id_col).cast("bigint"), F.col(ids_col)), path, "doc_id bigint, decoded string", lambda vocabulary, ids: (vocabulary.decode(ids or b""),))


def op13_digests(docs: DataFrame, path: str) -> DataFrame:
    """The registered query's columns: digests of each text's ids and of their decoded text."""
    return encoded(docs, path, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
