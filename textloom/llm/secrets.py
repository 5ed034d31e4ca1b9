"""Secret scanning with structural confirmation.

Patterns propose spans; the base kinds (assign, access, hex) are reported as
matched. The further kinds are reported only if decoding confirms a structure:

* ``jwt``: three base64url parts, of which the first decodes to a JSON object with
  an ``alg`` string (a signed-token header) and the second to a JSON object;
* ``pem``: a private-key block whose base64 body decodes to a private key's DER, to
  an OpenSSH container, or to an encrypted key's body;
* ``b64key`` and ``hexkey``: base64 or hex outside the above that decodes to a
  private key, wherever it starts in its run and over line breaks. The span is that
  of the key, padding included.

A private key's DER is a sequence whose nested lengths all fit and whose types are
those of PKCS #1, SEC 1, PKCS #8 (with such a key inside) or an encrypted PKCS #8
key. Public keys and certificates aren't reported.

Positions are code points, ends exclusive; matches of a kind don't overlap.
Defined results: a null text counts as empty and has no spans; repeated rows
keep a row each; long texts are scanned whole (a start of a key or token is judged
by the lengths it declares and read up to its first fault, so a megabyte of starts
takes some seconds); spans don't tie, as kinds are put in order and those of one
kind don't overlap; an empty table gives no rows. Only the two named columns are
read, so others can't clash.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bytewords import flat
from textloom.llm.scratch import small_batches

#: The kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "jwt", "pem", "b64key", "hexkey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs of base64url parts joined by dots, of which any three in a row may be a token.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
#: Where a header may begin inside a part: an object's brace and what may follow it, in base64.
BRACE = re.compile(r"(?<![A-Za-z0-9])e[yw]")
#: How an object with fields begins; where the bytes end early, what follows is open.
OBJECT_START = re.compile(rb'[\x20\t\r\n]*+\{[\x20\t\r\n]*+"(?:[^"\\]|\\.)*+(?:"[\x20\t\r\n]*+(?::|\Z)|\\?\Z)', re.S)
JSON, JSON_SPACE = json.JSONDecoder(), re.compile(r"[\x20\t\r\n]*")
MARKER = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----")
OPENSSH = b"openssh-key-v1\0"
#: A DER sequence's first byte and the class of its length, then enough for the first fields; or an OpenSSH container.
B64_START = re.compile(r"(?=(M[A-I][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZX))")
HEX_START = re.compile(r"(?=(30(?:8[1-4]|[0-7][0-9a-f])[0-9a-f]{20}|6f70656e7373682d6b6579))", re.I)
B64_RUN, HEX_RUN = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
#: A line break inside a key.
WRAP = r"[\x20\t]*(?:\r?\n|\\n)[\x20\t]*"
#: DER tags of integers, octet strings, object identifiers and sequences, of those that nest, and the encryption schemes' identifiers.
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30
NESTING = (0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3)
ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: No key nests deeper, and none is shorter (bytes).
DEPTH, LEAST = 16, 32


def der_header(data: Bytes, at: int = 0) -> tuple[int, int]:
    """(begin, end) of the content of the DER element at a position, (-1, -1) if its header is none."""
    head = data[at : at + 6]
    if len(head) < 2:
        return -1, -1
    length, at = head[1], at + 2
    if length >= 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or len(head) < 2 + size or not head[2] or size == 1 and head[2] < 0x80:
            return -1, -1
        length, at = int.from_bytes(head[2 : 2 + size], "big"), at + size
    return at, at + length


def der_children(data: Bytes, begin: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the elements that fill a range; None if they don't, or those that nest aren't filled."""
    out = []
    while begin < end:
        tag, (start, stop) = data[begin], der_header(data, begin)
        if start < 0 or stop > end or tag == INTEGER and start == stop:
            return None
        if tag in NESTING and (depth >= DEPTH or der_children(data, start, stop, depth + 1) is None):
            return None
        out.append((tag, start, stop))
        begin = stop
    return out


def is_der_key(data: Bytes) -> bool:
    """A DER sequence of the whole length that has a private key's types, with consistent nested lengths."""
    whole = der_children(data, 0, len(data))
    if not whole or len(whole) > 1 or whole[0][0] != SEQUENCE:
        return False
    fields = der_children(data, *whole[0][1:])
    tags, inside = [f[0] for f in fields], lambda k: data[fields[k][1] : fields[k][2]]
    if not tags:
        return False
    optional = lambda rest: all(t in (0xA0, 0xA1, 0x80, 0x81) for t in rest)
    if tags[0] == INTEGER and fields[0][2] - fields[0][1] == 1 and inside(0) in (b"\0", b"\1"):
        integers = tags[:-1] if tags[-1] == SEQUENCE and len(tags) == 10 else tags  # further primes
        if len(tags) >= 4 and set(integers) == {INTEGER}:
            return True
        if tags[1:2] == [OCTETS] and inside(0) == b"\1":
            return fields[1][2] > fields[1][1] and optional(tags[2:])
        if tags[1:3] == [SEQUENCE, OCTETS] and optional(tags[3:]):
            kind, body = der_children(data, *fields[1][1:]), inside(2)
            held = der_children(body, 0, len(body))
            lone = held and len(held) == 1 and held[0][0] in (OCTETS, INTEGER)
            return bool(kind) and kind[0][0] == OBJECT and bool(lone or is_der_key(body))
        return False
    if tags == [SEQUENCE, OCTETS] and fields[1][2] > fields[1][1]:
        kind = der_children(data, *fields[0][1:])
        return bool(kind) and kind[0][0] == OBJECT and data[kind[0][1] : kind[0][2]].startswith(ENCRYPTED)
    return False


def der_begins(data: bytes) -> int:
    """The length of the element that some first bytes begin, if a private key may begin so, else 0."""
    at, end = der_header(data)
    if data[:1] != b"\x30" or at < 0 or end < LEAST:
        return 0
    if data[at : at + 3] in (b"\2\1\0", b"\2\1\1") and data[at + 3 : at + 4] in (b"\2", b"\4", b"\x30"):
        return end
    inner, _ = der_header(data, at)
    return end if data[at] == SEQUENCE and 0 <= inner < len(data) and data[inner] == OBJECT else 0


def ssh_key_end(data: Bytes) -> int:
    """Where OpenSSH's private container ends by its nested lengths, 0 if it is none, or more bytes than there are if it goes on."""
    if data[: len(OPENSSH)] != OPENSSH:
        return 0
    at, fields, wanted = len(OPENSSH), [], 3
    while len(fields) < wanted:
        if at + 4 > len(data):
            return at + 4
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return at + 4 + size
        fields.append(size)
        at += 4 + size
        if len(fields) == 3 and wanted == 3:  # cipher, function and its options, then a count of public keys and the private part
            if at + 4 > len(data):
                return at + 4
            keys = int.from_bytes(data[at : at + 4], "big")
            if not 1 <= keys <= 16 or not fields[0] or not fields[1]:
                return 0
            wanted, at = 4 + keys, at + 4
    return at if all(fields[3:]) else 0


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's private container, of the whole length."""
    return bool(data) and ssh_key_end(data) == len(data)


def unbase64(text: str) -> bytes:
    """The decoded bytes of a standard or URL-safe run, padded or not; b"" if it has none."""
    body = text.translate(str.maketrans("-_", "+/")).rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True) if len(body) % 4 != 1 else b""
    except (binascii.Error, ValueError):
        return b""


def _json_object(part: str) -> dict:
    try:
        value = json.loads(unbase64(part).decode("utf-8"))
    except (UnicodeDecodeError, ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def is_signed_token(header: str, payload: str) -> bool:
    found = _json_object(header)
    return isinstance(found.get("alg"), str) and (bool(_json_object(payload)) or "enc" in found)


class Header:
    """A part whose places may begin an object that goes on to its end. It is decoded once for each place modulo four, and read up to the first fault."""

    def __init__(self, part: str) -> None:
        self.part, self.decoded = part, {}

    def is_object(self, begin: int) -> bool:
        phase = begin % 4
        if phase not in self.decoded:
            # A character a byte: what an object's syntax is made of is ASCII.
            self.decoded[phase] = unbase64(self.part[phase:]).decode("latin-1")
        body = self.decoded[phase]
        at = JSON_SPACE.match(body, (begin - phase) // 4 * 3).end()
        if not body.startswith("{", at):
            return False
        size = 1 << 10
        while True:
            window = body[at : at + size]
            try:
                _, end = JSON.raw_decode(window)
                return JSON_SPACE.match(body, at + end).end() == len(body)
            except RecursionError:
                return False
            except json.JSONDecodeError as fault:
                # Further characters can only mend an open string, or a value cut at the window's end.
                open_end = fault.msg.startswith("Unterminated string") or fault.pos > len(window) - 16
                if at + size >= len(body) or not open_end:
                    return False
            size *= 4


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens, the earliest first; a header may follow other letters of its part."""
    for m in DOTTED.finditer(text):
        at, done = m.start(), -1
        parts = m[0].split(".")
        places = []
        for part in parts:
            places.append(at)
            at += len(part) + 1
        for i in range(len(parts) - 2):
            if places[i] < done:
                continue
            header = Header(parts[i])
            for begin in (0, *(b.start() for b in BRACE.finditer(parts[i], 1))):
                if OBJECT_START.match(unbase64(parts[i][begin : begin + 240])) and header.is_object(begin) and is_signed_token(parts[i][begin:], parts[i + 1]):
                    done = places[i + 2] + len(parts[i + 2])
                    yield places[i] + begin, done
                    break


def is_private_key(body: str) -> bool:
    """Whether the body of a private-key block holds such a key, or an encrypted one under its headers."""
    lines = body.replace("\\n", "\n").split("\n")
    data = unbase64("".join(x.strip() for x in lines if ":" not in x))
    encrypted = any(x.strip().startswith(("Proc-Type:", "DEK-Info:")) for x in lines)
    return bool(data) and (is_der_key(data) or is_ssh_key(data) or encrypted and len(data) % 8 == 0)


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of private-key blocks: an end marker with the last begin marker of its label before it."""
    begun: dict[str, re.Match] = {}
    for m in MARKER.finditer(text):
        if m[1] == "BEGIN":
            begun[m[2]] = m
        elif begin := begun.pop(m[2], None):
            if is_private_key(text[begin.end() : m.start()]):
                yield begin.start(), m.end()


class Window:
    """Bytes that a run of characters encodes from a place on, decoded where they are looked at."""

    def __init__(self, chars: str, at: int, decode: Callable[[str], bytes], unit: tuple[int, int], size: int) -> None:
        self.chars, self.at, self.decode, self.unit, self.size = chars, at, decode, unit, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key: int | slice) -> int | bytes:
        if isinstance(key, int):
            return self[key : key + 1][0]
        low, high, _ = key.indices(self.size)
        if low >= high:
            return b""
        (letters, count), first = self.unit, low // self.unit[1]
        last = -(-high // count)
        return self.decode(self.chars[self.at + first * letters : self.at + last * letters])[low - first * count : high - first * count]


Bytes = bytes | Window


class Runs:
    """The runs of a text that a kind of key may lie in, joined over line breaks."""

    def __init__(self, text: str, run: re.Pattern) -> None:
        self.text, self.run = text, run
        self.whole = re.compile(f"{run.pattern}(?:{WRAP}{run.pattern})*")
        self.begin, self.end = 0, -1

    def at(self, place: int) -> tuple[str, int]:
        """(characters, index) of the joined run around a place in it; places are asked for in order."""
        if place >= self.end:
            # From the start of the line's run: the pattern has a match from every place of one.
            whole = self.whole.match(self.text, place)
            self.begin, self.end = whole.span()
            self.starts = [(m.start(), m.end()) for m in self.run.finditer(self.text, self.begin, self.end)]
            self.starts = _without_breaks(self.text, self.starts)
            self.chars = "".join(self.text[a:b] for a, b in self.starts)
            self.sums = [0, *accumulate(b - a for a, b in self.starts)]
        k = bisect_right(self.starts, (place, len(self.text))) - 1
        return self.chars, self.sums[k] + place - self.starts[k][0]

    def place(self, index: int) -> int:
        """The place in the text behind the index-th character."""
        k = bisect_right(self.sums, index - 1) - 1
        return self.starts[k][0] + index - self.sums[k]


def _without_breaks(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without the letter of a line break that is written as a backslash and an n."""
    return [(a + (a > 0 and text[a - 1] == "\\" and text[a] == "n"), b) for a, b in runs]


def bare_keys(text: str, start: re.Pattern, run: re.Pattern, decode: Callable[[str], bytes], unit: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Spans of private keys in base64 (a unit of four characters for three bytes) or hex (two for one), the earliest first.

    What a start declares to be longer than its run is refused at once; the rest
    is read by its nested headers, not as a whole.
    """
    done, runs, (letters, count) = -1, Runs(text, run), unit
    for m in start.finditer(text):
        if m.start() < done:
            continue
        chars, at = runs.at(m.start())
        units, rest = divmod(len(chars) - at, letters)
        there = units * count + rest * count // letters
        first = Window(chars, at, decode, unit, there)[:24]
        if first.startswith(OPENSSH):
            whole = Window(chars, at, decode, unit, there)
            wanted = ssh_key_end(whole)
            confirmed = 0 < wanted <= there
        else:
            wanted = der_begins(first)
            confirmed = 0 < wanted <= there and is_der_key(Window(chars, at, decode, unit, wanted))
        if confirmed:
            held = -(-wanted * letters // count)
            end = runs.place(at + held)
            while text[end : end + 1] == "=" and run is B64_RUN and held % 4:
                held, end = held + 1, end + 1
            done = end
            yield m.start(), end


def unhex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


#: Bytes of the runs that hex and the bare keys need, and the least length of such a run: that of an OpenSSH container's start.
RUN_BYTES = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8))
RUN_LENGTH = 14


def with_runs(column: pa.Array) -> np.ndarray:
    """Which rows have a run of RUN_LENGTH bytes that hex or base64 could be."""
    data, offs = flat(column)
    out = np.zeros(len(column), bool)
    at, breaks = 0, np.array([-1])
    for at in range(0, len(data), 1 << 20):
        found = np.flatnonzero(~RUN_BYTES[data[at : at + (1 << 20)]]) + at
        breaks = np.concatenate([breaks[-1:], found])
        begin = breaks[:-1][np.diff(breaks) > RUN_LENGTH] + 1
        out[_rows(begin, breaks, offs)] = True
    if len(data) - breaks[-1] > RUN_LENGTH:
        out[np.searchsorted(offs, breaks[-1] + 1, "right") - 1 :] = True
    return out


def _rows(begin: np.ndarray, breaks: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """All rows that the runs beginning at ``begin`` touch."""
    if not len(begin):
        return np.empty(0, np.int64)
    end = breaks[np.searchsorted(breaks, begin, "left")]
    first, last = np.searchsorted(offs, begin, "right") - 1, np.searchsorted(offs, end, "left") - 1
    return np.unique(np.concatenate([np.arange(a, max(a, b) + 1) for a, b in zip(first, last, strict=True)])).clip(0, len(offs) - 2)


def scan(text: str | None, runs: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then kind as listed.

    ``runs`` may be false only for a text that ``with_runs`` rules out.
    """
    if not text:
        return []
    found = []
    add = lambda kind, ms: found.extend((m.start(), m.end(), kind) for m in ms)
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        add("assign", (m for m in ASSIGN.finditer(text) if len(m[2]) >= 6))
    if "AKIA" in text:
        add("access", (m for m in ACCESS.finditer(text) if len(m[0]) >= 20))
    if runs:
        add("hex", HEX.finditer(text))
    if "PRIVATE KEY-----" in text:
        found.extend((a, b, "pem") for a, b in key_blocks(text))
    if "." in text:
        found.extend((a, b, "jwt") for a, b in signed_tokens(text))
    if not runs:
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))
    # Ends rise with starts, also where a token lies in a block.
    inside = sorted((a, b) for a, b, kind in found if kind in ("jwt", "pem"))
    starts, ends = [a for a, _ in inside], list(accumulate((b for _, b in inside), max))
    for kind, *how in (("b64key", B64_START, B64_RUN, unbase64, (4, 3)), ("hexkey", HEX_START, HEX_RUN, unhex, (2, 1))):
        for a, b in bare_keys(text, *how):
            k = bisect_right(starts, b - 1)
            if not k or ends[k - 1] <= a:
                found.append((a, b, kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): per row, the spans as an array of (kind, start, end)."""
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(k, s, e) for s, e, k in scan(t.as_py(), r)] for t, r in zip(batch.column(1), with_runs(batch.column(1)), strict=True)]
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], ["doc_id", "spans"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, spans array<struct<kind: string, start: int, end: int>>")


def op2_secrets(docs: DataFrame) -> DataFrame:
    """The registered query: counts of the base kinds, a digest of their spans, and all spans."""
    of = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:3]))
    return secret_spans(docs).select(
        "doc_id",
        *(of(F.col("spans"), kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def digest(spans: list[tuple[int, int, str]]) -> str:
    """``base_sha256`` of a scan's result."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in KINDS[:3]).encode()).hexdigest()
