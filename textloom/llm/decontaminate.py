"""Benchmark decontamination with spaced seeds.

A seed hashes the tokens under the ones of a fixed mask and ignores those under
its zeros, so a substituted token spoils only the seeds that look at it. Seeds
of the benchmark and of the documents meet by hash. A hit lays the item on the
document's tokens; on each such alignment the longest run is taken of whose
tokens at least MISMATCH / (MISMATCH + 1) are equal. A run starts and ends at an
equal token, unless it is the whole item, and counts from ``min_tokens`` tokens
on (or the item's length, if that is less).

All runs are reported: alignments are taken by falling number of hits, then from
the front, and on each the longest runs among tokens of the document that no
earlier run of the item covers. So a passage that a document repeats is reported
each time, and a text that repeats itself isn't compared with all its shifts.

A phrase that many items and documents share makes an alignment for each pair of
them. Their equal tokens are counted for many pairs at once; an alignment with
fewer than the shortest run needs has none and is passed over, so only pairs
that may overlap are looked at one by one.

The benchmark is worked off in blocks of bounded size, each broadcast and
joined with the documents in the scan; documents are never shuffled. More
benchmark means more blocks, not larger ones (one item is never split). Tokens
are compared by 64-bit hashes.

Defined results: null and empty texts match nothing; an item of fewer tokens
than the shortest mask is searched for as a whole, without substitutions. Items
with equal text are all reported. Repeated rows are reported each. Texts and
items of any length are compared whole, in memory that grows with their
lengths, not with the product. An empty table on either side gives no overlaps.
Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bytewords import Lookup, mix, word_hashes
from textloom.llm.scratch import materialize, small_batches

#: Tokens under a 1 are hashed, those under a 0 ignored.
MASKS = ("11011", "1101001")
MISMATCH = 4
MIN_TOKENS = 13
#: UTF-8 bytes of benchmark text in one block.
BLOCK_BYTES = 4 << 20
#: Places and tokens that are looked at in one go, and hits of a portion of rows and items.
PIECE, HITS = 1 << 20, 1 << 20
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position of a token sequence that it fits at."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, _ODD[len(mask)], np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += tokens[k : k + n] * _ODD[k]
    return mix(out)


def longest_run(equal: np.ndarray, whole: bool) -> tuple[int, int]:
    """(start, end) of the longest run with MISMATCH / (MISMATCH + 1) equal tokens, the first if tied; empty if none is equal.

    A run starts and ends at an equal token, except that all of ``equal`` counts
    if it lies on a ``whole`` item.
    """
    n = len(equal)
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    if whole and n and score[n] >= 0:
        return 0, n
    starts = np.flatnonzero(equal)
    if not len(starts):
        return 0, 0
    ends = starts + 1
    most = np.maximum.accumulate(score[ends][::-1])  # over the ends from each one on, last end first
    last = ends[len(ends) - 1 - np.searchsorted(most, score[starts])]
    k = int(np.argmax(last - starts))
    return int(starts[k]), int(last[k])


class Seeds:
    """The places of one mask's seeds in some items."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], mask: str):
        self.mask = mask
        own = [seeds(items[i], mask) for i in numbers]
        sizes = [len(s) for s in own]
        keys = np.concatenate([np.empty(0, np.uint64), *own])
        item = np.repeat(np.array(numbers, np.int64), sizes)
        place = np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)]).astype(np.int64)
        order = np.lexsort((place, item, keys))
        keys, item, self.place = keys[order], item[order], place[order]
        # A group holds the places of one seed in one item; a key's groups lie together, by item.
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])
        self.begin = np.append(np.flatnonzero(new), len(keys))
        self.item = item[self.begin[:-1]]
        unique, at = np.unique(keys[self.begin[:-1]], return_inverse=True)
        self.lookup, self.items = Lookup(unique), len(items)
        self.ordered = at.ravel() * self.items + self.item

    def found(self, hashes: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key) of every seed of the rows that an item has."""
        found, at = self.lookup.find(seeds(hashes, self.mask))
        inside = row_of[found] == row_of[found + len(self.mask) - 1] if len(found) else np.zeros(0, bool)
        return found[inside], at[inside]

    def groups(self, keys: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The first group and the number of groups of each key, of the items from ``low`` to ``high``."""
        first = np.searchsorted(self.ordered, keys * self.items + low)
        return first, np.searchsorted(self.ordered, keys * self.items + high) - first


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start and length, in one array."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


class Index:
    """Seeds of one block of benchmark items."""

    def __init__(self, texts: list[str], min_tokens: int):
        self.min_tokens = min_tokens
        hashes, bounds = word_hashes(pa.array(texts, pa.string()))
        self.items = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        shortest = min(map(len, MASKS))
        of_length = lambda n: [i for i, t in enumerate(self.items) if len(t) == n]
        whole = [(numbers, "1" * n) for n in range(1, shortest) if (numbers := of_length(n))]
        long = [i for i, t in enumerate(self.items) if len(t) >= shortest]
        self.seeds = [Seeds(self.items, numbers, mask) for numbers, mask in [*whole, *((long, m) for m in MASKS)]]

        self.flat = np.concatenate([np.empty(0, np.uint64), *self.items])
        self.starts = np.cumsum([0, *map(len, self.items)])

    def overlaps(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, start, end, item_start, equal): the runs of each item in each row.

        Rows and items are taken in portions of some HITS hits (at least one
        item in one row), so a phrase that all items and rows share takes time,
        not memory.
        """
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found = [own.found(hashes, row_of) for own in self.seeds]
        sums = np.zeros(len(bounds), np.int64)
        for own, (pos, keys) in zip(self.seeds, found, strict=True):
            sums[1:] += np.bincount(row_of[pos], own.groups(keys, 0, own.items)[1], len(bounds) - 1).astype(np.int64)
        sums = np.cumsum(sums)
        row = 0
        while row < len(bounds) - 1:
            end = max(row + 1, int(np.searchsorted(sums, sums[row] + HITS, "right")) - 1)
            if sums[end] > sums[row]:
                parts = []
                for pos, keys in found:
                    inside = slice(*np.searchsorted(pos, (bounds[row], bounds[end])))
                    parts.append((pos[inside], keys[inside]))
                yield from self._portion(hashes, bounds, row_of, parts, 0, len(self.items))
            row = end

    def _portion(self, hashes: np.ndarray, bounds: np.ndarray, row_of: np.ndarray, parts: list, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """The runs of the items from ``low`` to ``high`` in some rows, whose (position, key) hits are given by seeds."""
        sides = [own.groups(keys, low, high) for own, (_, keys) in zip(self.seeds, parts, strict=True)]
        if sum(int(n.sum()) for _, n in sides) > HITS and high - low > 1:
            middle = (low + high) // 2
            yield from self._portion(hashes, bounds, row_of, parts, low, middle)
            yield from self._portion(hashes, bounds, row_of, parts, middle, high)
            return
        base = np.cumsum([0, *(len(own.place) for own in self.seeds)])
        columns = []
        for own, offset, (pos, _), (first, n) in zip(self.seeds, base, parts, sides, strict=False):
            group, at = _ranges(first, n), np.repeat(pos, n)
            columns.append((row_of[at] * len(self.items) + own.item[group], at, own.begin[group] + offset, own.begin[group + 1] - own.begin[group]))
        pair, pos, first, n = (np.concatenate(c) for c in zip(*columns, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, pos, first, n = pair[order], pos[order], first[order], n[order]
        places = np.concatenate([own.place for own in self.seeds])
        new = np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair))
        size = np.add.reduceat(n, new[:-1]) if len(pair) else n
        at = 0
        while at < len(size):
            # Pairs of PIECE places together, or one with more.
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), PIECE, "right")))
            one = slice(new[at], new[end])
            yield from self._pairs(hashes, bounds, pair[new[at:end]], np.diff(new[at : end + 1]), pos[one], first[one], n[one], places)
            at = end

    def _pairs(self, hashes, bounds, pair, sizes, pos, first, n, places) -> Iterator[tuple[int, int, int, int, int, int]]:
        """The runs of (row, item) pairs, of which each has the next ``sizes`` of the hits."""
        rows, items = np.divmod(pair, len(self.items))
        doc, doc_size = bounds[rows], bounds[rows + 1] - bounds[rows]
        start, item_size = self.starts[items], np.diff(self.starts)[items]
        # Alignments, counted by pair and shift; a shift is item_size less than its place in the pair's counts.
        offset = np.cumsum(np.append(0, doc_size + item_size))
        of = np.repeat(np.arange(len(pair)), sizes)
        total = int(n.sum())
        dense = np.zeros(offset[-1] if offset[-1] <= max(PIECE, total) else 0, np.int64)
        slots, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.searchsorted(np.cumsum(n), np.arange(PIECE, total, PIECE), "right")
        for part in np.split(np.arange(len(n)), np.unique(cuts)):
            here = offset[of[part]] + pos[part] - doc[of[part]] + item_size[of[part]]
            here = np.repeat(here, n[part]) - places[_ranges(first[part], n[part])]
            if len(dense):
                dense += np.bincount(here, minlength=len(dense))
            else:
                new, more = np.unique(here, return_counts=True)
                slots, inverse = np.unique(np.concatenate([slots, new]), return_inverse=True)
                hits = np.bincount(inverse.ravel(), np.concatenate([hits, more])).astype(np.int64)
        if len(dense):
            slots = np.flatnonzero(dense)
            hits = dense[slots]
        of = np.searchsorted(offset, slots, "right") - 1
        shift = slots - offset[of] - item_size[of]
        # An alignment with too few equal tokens for the shortest run has none.
        low, high = np.maximum(0, shift), np.minimum(doc_size[of], shift + item_size[of])
        least = np.minimum(self.min_tokens, item_size)
        enough = np.zeros(len(of), bool)
        ends = np.cumsum(high - low)
        for part in np.split(np.arange(len(of)), np.unique(np.searchsorted(ends, np.arange(PIECE, int(ends[-1]), PIECE), "right"))):
            if len(part):
                length = (high - low)[part]
                same = hashes[_ranges((doc[of] + low)[part], length)] == self.flat[_ranges((start[of] + low - shift)[part], length)]
                sums = np.concatenate([[0], np.cumsum(same)])
                stop = np.cumsum(length)
                enough[part] = (MISMATCH + 1) * (sums[stop] - sums[stop - length]) >= MISMATCH * least[of[part]]
        of, shift, hits = of[enough], shift[enough], hits[enough]
        edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = int(of[a])
            text, tokens = hashes[doc[k] : doc[k] + doc_size[k]], self.items[int(items[k])]
            for begin, end, by, same in runs(text, tokens, shift[a:b], hits[a:b], int(least[k])):
                yield int(rows[k]), int(items[k]), begin, end, begin - by, same


def runs(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray, hits: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, shift, equal tokens): the runs on the alignments of rising ``shifts``, those of most ``hits`` first."""
    free, left = np.ones(len(doc), bool), len(doc)
    for shift in shifts[np.argsort(-hits, kind="stable")].tolist():
        lo, hi = max(0, shift), min(len(doc), shift + len(item))
        if left < least:
            return
        if np.count_nonzero(free[lo:hi]) < least:
            continue
        equal, open_ = doc[lo:hi] == item[lo - shift : hi - shift], free[lo:hi]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        todo = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        while todo:
            a, b = todo.pop()
            if b - a < least or (MISMATCH + 1) * np.count_nonzero(equal[a:b]) < MISMATCH * least:
                continue
            start, end = longest_run(equal[a:b], b - a == len(item))
            if end - start >= least:
                start, end = a + start, a + end
                yield lo + start, lo + end, shift, int(np.count_nonzero(equal[start:end]))
                free[lo + start : lo + end] = False
                left -= end - start
                todo += [(a, start), (end, b)]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[list[int]], list[str]]]:
    """Item ids and text of each distinct text, block by block."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    distinct = materialize(items.groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids")), "items")
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        block = distinct.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        yield [list(r.ids) for r in block], [r.text for r in block]


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """One row per run of a benchmark item in a document row.

    doc_id, item_id, doc_start and doc_end (token positions, end exclusive),
    item_start, equal_tokens, similarity (equal share of the run) and coverage
    (equal share of the item).
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id bigint, item_id bigint, doc_start int, doc_end int, item_start int, equal_tokens int, similarity double, coverage double"
    names = [part.split()[0] for part in schema.split(", ")]
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for ids, texts in blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast((ids, Index(texts, min_tokens)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            for batch in batches:
                doc_ids, rows = batch.column(0), []
                for row, item, start, end, offset, same in index.overlaps(*word_hashes(batch.column(1))):
                    shares = (same / (end - start), same / len(index.items[item]))
                    rows += [(doc_ids[row].as_py(), i, start, end, offset, same, *shares) for i in ids[item]]
                if rows:
                    columns = zip(*rows, strict=True)
                    kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        out = out.unionByName(chosen.mapInArrow(run, schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_tokens: int = MIN_TOKENS, decisive: int = 1) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item by a run of ``decisive`` equal tokens, all columns as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    place = docs.columns.index(text_col)
    for _, texts in blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(Index(texts, min_tokens))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[hit[0] for hit in shared.value.overlaps(*word_hashes(batch.column(place))) if hit[5] >= decisive]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
