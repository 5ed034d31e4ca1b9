"""Words of Arrow string columns as 64-bit hashes, computed on the bytes with numpy.

A word is a run of ASCII letters, digits, ``_`` and non-ASCII characters other
than general punctuation and Latin-1 spaces and quotes; A-Z and the Latin-1
capitals are lower-cased. The buffer is worked off in pieces cut between words,
so memory doesn't follow the length of a text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
FOLD = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
WORD = (_BYTES >= 128) | _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES == 95)


@cache
def _powers() -> np.ndarray:
    return np.multiply.accumulate(np.full(PIECE * 2, _BASE | np.uint64(1)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and the rows' offsets in them (nulls are empty)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit words over all bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and which of them belong to words."""
    low, word = FOLD[data], WORD[data]
    for at in (i for i in (np.flatnonzero(data[:-1] == 0xC3),) if len(i)):
        after = data[at + 1]
        capital = (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        low[at[capital] + 1] += 0x20
    for at in (i for i in (np.flatnonzero(data[:-1] == 0xC2),) if len(i)):
        at = at[np.isin(data[at + 1], (0xA0, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF))]
        word[at] = word[at + 1] = False
    for at in (i for i in (np.flatnonzero(data[:-2] == 0xE2),) if len(i)):
        at = at[data[at + 1] == 0x80]
        for k in range(3):
            word[at + k] = False
    return low, word


def _piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, word = folded(data)
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[breaks] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], lengths)
    powers = _powers() if len(data) <= PIECE * 2 else np.multiply.accumulate(np.full(len(data), _BASE | np.uint64(1)))
    terms = (low[starts[0] :].astype(np.uint64) + np.uint64(1)) * powers[place]
    terms[~word[starts[0] :]] = 0
    return mix(np.add.reduceat(terms, starts - starts[0])), starts


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of all rows in order; row i has hashes[bounds[i]:bounds[i + 1]]."""
    data, offs = flat(column)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and WORD[data[end - 1]] and WORD[data[end]]:  # not inside a word
            gap = np.flatnonzero(~WORD[data[end : end + 4096]])
            end = end + int(gap[0]) if len(gap) else min(end + 4096, len(data))
        inner = offs[np.searchsorted(offs, at) : np.searchsorted(offs, end)] - at
        h, s = _piece(data[at:end], inner)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offs), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offs)


class Lookup:
    """Positions of 64-bit keys in a sorted array, by a direct-address table before a binary search."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        self.keys = keys
        self.shift = np.uint64(64 - bits)
        self.taken = np.zeros(1 << bits, bool)
        self.taken[keys >> self.shift] = True

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, at): wanted[i] == keys[at], for all i that have a match."""
        i = np.flatnonzero(self.taken[wanted >> self.shift])
        at = np.searchsorted(self.keys, wanted[i])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == wanted[i] if len(self.keys) else np.zeros(len(i), bool)
        return i[same], at[same]
