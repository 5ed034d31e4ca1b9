"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints are compared in tiles with numpy exclusive-or and bit counts. A
tile holds fingerprints of one population count; two fingerprints within the
radius have population counts that differ by the radius at most, so other tile
pairs are never formed. Inside a pair the rows are ordered by the population
count of their high half, and blocks whose halves differ too much are skipped.
Each tile pair returns a spanning forest of its links, never all pairs, which
keeps the output linear in the tile size and loses no link between components.

Defined results: a null or blank text has fingerprint zero, linked like any
other; equal fingerprints share a component; a component's id is its least
non-null doc_id (null only if it has none); repeated rows keep a row each. Whole
texts are hashed, however long. An empty table gives no rows. Columns other than
the two named ones are not read; ``deduplicate`` keeps them all, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textloom.llm.components import connected_components
from textloom.llm.scratch import checked_broadcast, materialize, small_batches

SEED = 42
LANES = np.uint64(0x0101010101010101)
#: A byte lane counts this many rows without overflow.
LANE_ROWS = 255
#: Tiles on either side of one task's grid of tile pairs.
GROUP = 16
#: Fingerprint pairs that one task compares, about.
TASK_PAIRS = 200_000_000


def shingle_hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """XXH64 of the word shingles of a UTF-8 text, A-Z lower-cased, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)


def fingerprints_of(texts: Iterable[bytes | None], width: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if it is in over half of the hashes.

    Bits are counted eight at a time in the byte lanes of 64-bit words, over
    segments short enough not to overflow, then summed by text.
    """
    return majority([shingle_hashes(t, width) for t in texts])


def majority(per_text: list[np.ndarray]) -> np.ndarray:
    """``fingerprints_of`` texts whose shingle hashes are given."""
    sizes = np.array([len(h) for h in per_text], np.int64)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    hashes, sizes = np.concatenate([per_text[i] for i in full]), sizes[full]
    segments = -(-sizes // LANE_ROWS)
    first = np.cumsum(segments) - segments
    within = np.arange(segments.sum()) - np.repeat(first, segments)
    starts = np.repeat(np.cumsum(sizes) - sizes, segments) + within * LANE_ROWS
    result = np.zeros(len(full), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = counts * 2 > sizes[:, None]
        for byte in range(8):
            result |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = result
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, content: Column | None = None) -> DataFrame:
    """(doc_id, content, fp): the fingerprint of each whole text, as a signed bigint.

    ``content`` is a bigint column that is passed on, null if not given.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints_of(batch.column(2).cast(pa.binary()).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "content", "fp"])

    content = F.lit(None).cast("bigint") if content is None else content
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), content.alias("content"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, content bigint, fp bigint")


class Forest:
    """Vectorised union-find: labels fall to the least index of their component."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool, rows: int = 256, cols: int = 1024) -> np.ndarray:
    """Spanning links (node, root) between all fingerprints of two tiles within the radius.

    Exact: every pair of rows is either compared or lies in blocks whose high
    halves' population counts differ by more than the radius.
    """
    half = lambda x: np.bitwise_count(x >> np.uint64(32)).astype(np.int64)
    a = a[np.argsort(half(a), kind="stable")]
    b = a if same else b[np.argsort(half(b), kind="stable")]
    high_a, high_b = half(a), half(b)
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    forest = Forest(len(nodes))
    for i in range(0, len(a), rows):
        part = a[i : i + rows]
        lo = np.searchsorted(high_b, high_a[i] - radius, "left")
        hi = np.searchsorted(high_b, high_a[i + len(part) - 1] + radius, "right")
        for j in range(max(lo, i) if same else lo, hi, cols):
            other = b[j : min(j + cols, hi)]
            near = np.bitwise_count(part[:, None] ^ other[None, :]) <= radius
            if near.any():
                left, right = forest.label[i : i + len(part)], forest.label[shift + j : shift + j + len(other)]
                near &= left[:, None] != right[None, :]
                u, v = np.nonzero(near)
                if len(u):
                    forest.link(u + i, v + shift + j)
    moved = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[forest.label[moved]]], axis=1)


def links(distinct: DataFrame, radius: int = 2, tile_rows: int = 8192) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints within ``radius`` bits.

    ``distinct`` has one bigint column ``fp`` without repeats. Only the 65
    counts of the population counts reach the driver. A tile is a hash share of
    one population count, so its size is bounded whatever the data; tiles are
    dealt in a grid of GROUP x GROUP pairs, so a task holds 2 * GROUP tiles at
    most and a tile is sent once for each group it meets, not for each tile.
    """
    keyed = distinct.select("fp", F.bit_count("fp").cast("int").alias("p"))
    sizes = {r.p: r["count"] for r in keyed.groupBy("p").count().collect()}
    tiles = {p: -(-n // tile_rows) for p, n in sizes.items()} or {0: 1}
    compared = sum(n * sum(sizes.get(p + d, 0) for d in range(radius + 1)) for p, n in sizes.items())
    parts = max(distinct.sparkSession.sparkContext.defaultParallelism, min(compared // TASK_PAIRS, 20_000))
    numbers = lambda of: F.create_map(*(F.lit(x).cast("int") for kv in sorted(of.items()) for x in kv))
    groups = numbers({p: -(-n // GROUP) for p, n in tiles.items()})
    packed = (
        keyed.withColumn("s", F.pmod(F.xxhash64("fp"), F.element_at(numbers(tiles), F.col("p"))).cast("int"))
        .groupBy("p", "s")
        .agg(F.collect_list("fp").alias("fps"))
        .withColumn("g", F.floor(F.col("s") / GROUP).cast("int"))
    )
    # A group of population count p meets those of p to p + radius, and from itself on those of p.
    lower = packed.select("p", "g", "s", "fps", F.explode(F.sequence(F.col("p"), F.col("p") + radius)).alias("q")).withColumn("n", F.try_element_at(groups, F.col("q")))
    lower = lower.where("n is not null").withColumn("h", F.explode(F.sequence(F.when(F.col("p") == F.col("q"), F.col("g")).otherwise(0), F.col("n") - 1)))
    upper = packed.select(F.col("p").alias("q"), F.col("g").alias("h"), "s", "fps", F.explode(F.sequence(F.col("p") - radius, F.col("p"))).alias("p")).withColumn("n", F.try_element_at(groups, F.col("p")))
    last = F.when(F.col("p") == F.col("q"), F.col("h")).otherwise(F.col("n") - 1)
    upper = upper.where("n is not null").withColumn("g", F.explode(F.sequence(F.lit(0), last)))
    key = ["p", "g", "q", "h"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p, g, q, h = (left[c][0].as_py() if left.num_rows else None for c in key)
        own = [(s.as_py(), x.values.to_numpy().view(np.uint64)) for s, x in zip(left["s"], left["fps"], strict=True)]
        others = [(s.as_py(), x.values.to_numpy().view(np.uint64)) for s, x in zip(right["s"], right["fps"], strict=True)]
        found = [np.empty((0, 2), np.uint64)]
        for s, a in own:
            for t, b in others:
                if (p, g) != (q, h) or s <= t:
                    found.append(tile_links(a, b, radius, (p, s) == (q, t)))
        both = np.concatenate(found).view(np.int64)
        return pa.table([pa.array(np.ascontiguousarray(both[:, c])) for c in (0, 1)], ["a", "b"])

    sides = [x.select(*key, "s", "fps").repartition(parts, *key).groupBy(*key) for x in (lower, upper)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fp and component_id, the least doc_id reachable."""
    marked = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "distinct")
    rooted = connected_components(links(distinct.select("fp"), radius), "a", "b").withColumnRenamed("node", "fp")
    linked = rooted.join(distinct.select("fp", "doc"), "fp")
    least = linked.groupBy("root").agg(F.min("doc").alias("component"))
    grouped = linked.select("fp", "root").join(least, "root").select("fp", "component")
    copied = distinct.where("n > 1").join(grouped, "fp", "left_anti").select("fp", F.col("doc").alias("component"))
    found = marked.join(grouped.union(copied), "fp", "left")
    return found.select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def fingerprint_hex(fp: Column) -> Column:
    """Sixteen lower-case hex digits of a signed bigint column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, all columns as they are: the least by id (nulls last), then by content hash.

    The survivors are found on narrow rows of fingerprint, id and content hash;
    only then are they joined back to the documents.
    """
    content = F.xxhash64(*docs.columns)
    marked = materialize(fingerprints(docs, id_col, text_col, width, content), "fingerprints")
    rooted = connected_components(links(marked.select("fp").distinct(), radius), "a", "b").withColumnRenamed("node", "fp")
    return deduplicate_by(docs, marked, rooted, id_col, content)


def deduplicate_by(docs: DataFrame, marked: DataFrame, rooted: DataFrame, id_col: str, content: Column) -> DataFrame:
    """One row of each group: ``marked`` has doc_id, content and fp of every row, ``rooted`` the root of each linked fp."""
    identity = marked.join(rooted, "fp", "left").select("doc_id", "content", F.coalesce("root", "fp").alias("root"))
    counted = materialize(identity.groupBy("root", "doc_id", "content").agg(F.count("*").alias("n")), "identity")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("kept")
    leads = counted.groupBy("root").agg(first, F.count("*").alias("members")).where("members > 1")
    # Written first, so that the join reads two exchanges and a root of many rows can be split.
    leads = checked_broadcast(materialize(leads, "leads"))
    dropped = counted.join(leads, "root").where("not (doc_id <=> kept.doc_id and content = kept.content)").select("doc_id", "content")

    mark = next(name for k in range(len(docs.columns) + 1) if (name := f"content_{k}") not in map(str.lower, docs.columns))

    def same(rows: DataFrame) -> Column:
        return (docs_hashed[mark] == rows["content"]) & docs_hashed[id_col].cast("bigint").eqNullSafe(rows["doc_id"])

    docs_hashed = docs.withColumn(mark, content)
    dropped = checked_broadcast(materialize(dropped, "dropped"))
    kept = docs_hashed.join(dropped, same(dropped), "left_anti")
    repeated = materialize(counted.where("n > 1").select("doc_id", "content"), "repeated")
    if repeated.isEmpty():
        return kept.drop(mark)
    repeated = checked_broadcast(repeated)
    docs_hashed = kept
    once = kept.join(repeated, same(repeated), "left_anti").drop(mark)
    # Rows of one hash and id are equal in all columns, so any of them stands for all.
    many = kept.join(repeated, same(repeated), "left_semi").groupBy(mark, id_col).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return once.union(many.select("row.*"))
