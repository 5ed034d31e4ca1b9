"""Near copies by the Jaccard similarity of word-shingle sets, every link confirmed exactly.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more; a group is a connected component of such pairs.
Candidates come by SimHash first: five-word fingerprints within RADIUS bits, by
the tiled exact comparison of ``simhash``; of each group of a tile pair every text is
compared with one of them. Those links are confirmed with the first ones by bands.
Further candidates share one of BANDS bands of ROWS minimum hashes: a pair at 0.8
shares none with a probability of (1 - 0.8 ** 5) ** 32 = 3e-6, and closer pairs
far less often. The texts of a band's bucket are first compared with one of them, another
in each bucket and round; where that leaves a bucket in several components, all
its pairs across components are compared in tiles of bounded size that return
spanning links, so no candidate pair goes unjudged that could join two groups.

Fingerprints alone can't give this result: of pairs at a similarity of 0.80 to 0.86,
five-word SimHash fingerprints have 0.35 within 8 bits, 0.89 within 14 and 0.997
within 20, and 2 of 1000 unrelated pairs are within 20 bits, too.

Texts of equal shingle sets are one node, a 64-bit hash of the set. In a set
shingles are told apart by 64 bits of hash, and shipped and compared by 32 of
them: of two texts of 10,000 shingles about 0.02 match by chance.

Defined results: a text of fewer words than the width is one shingle; null and
blank texts are node zero and one group. Of a group the row with the least id
stays, nulls last; rows that repeat in all columns are one row. Whole texts are
compared, however long. An empty table gives no rows. All columns are kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.bytewords import mix
from textloom.llm.components import connected_components
from textloom.llm.scratch import checked_broadcast, materialize, small_batches
from textloom.llm.simhash import deduplicate_by, majority, shingle_hashes
from textloom.llm.simhash import links as fingerprint_links

WIDTH = 5
BANDS, ROWS = 32, 5
#: Bits in which fingerprints of a group may differ.
RADIUS = 2
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_XOR = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))
#: Shingles whose minimum hashes are taken at once.
PIECE = 1 << 16
#: Rounds in which the texts of a bucket are compared with one of them, before all pairs that are left.
STARS = 2
#: Texts of a bucket that are compared in one go.
TILE = 512


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(text, width))


def set_id(shingles: np.ndarray) -> np.uint64:
    """One hash of a shingle set, zero for the empty set."""
    return mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0] if len(shingles) else np.uint64(0)


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) hashes of the bands' minimum hashes; sets must not be empty."""
    out = np.empty((len(sets), BANDS), np.uint64)
    at = 0
    while at < len(sets):
        end, held = at + 1, len(sets[at])
        while end < len(sets) and held + len(sets[end]) <= PIECE:
            held += len(sets[end])
            end += 1
        hashes = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for band in range(BANDS):
            key = np.full(end - at, band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = mix(key ^ np.minimum.reduceat((hashes ^ _XOR[k]) * _ODD[k], starts))
            out[at:end, band] = key
        at = end
    return out


def marks(docs: DataFrame, id_col: str, text_col: str, content: Column) -> DataFrame:
    """(doc_id, content, fp, n, bands, sim): set id, set size, band hashes and SimHash of each text; bands are null for an empty set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            hashes = [shingle_hashes(t, WIDTH) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            sim = pa.array(majority(hashes).view(np.int64))
            sets = [np.unique(h) for h in hashes]
            full = [s for s in sets if len(s)]
            own = iter(band_hashes(full).view(np.int64).tolist() if full else ())
            bands = pa.array([next(own) if len(s) else None for s in sets], kind)
            fp = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), bands, sim], ["doc_id", "content", "fp", "n", "bands", "sim"]
            )

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), content.alias("content"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, content bigint, fp bigint, n bigint, bands array<bigint>, sim bigint")


def _sets(texts: DataFrame) -> DataFrame:
    """(fp, s): the shingle sets of a text column, once each, as 32 bits of each shingle, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            fp = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
            short = [(s >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(short, pa.list_(pa.int32()))], ["fp", "s"])

    return texts.mapInArrow(run, "fp bigint, s array<int>").groupBy("fp").agg(F.first("s").alias("s"))


def _needed(sets: DataFrame, fps: DataFrame) -> DataFrame:
    """The sets of some ids, so that no others are shuffled."""
    return sets.join(checked_broadcast(materialize(fps.distinct(), "needed")), "fp", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of a Jaccard similarity of 0.8 or more, in integers."""
    pairs = materialize(pairs, "pairs")
    sets = _needed(sets, pairs.select(F.explode(F.array("u", "v")).alias("fp")))
    left, right = (sets.select(F.col("fp").alias(c), F.col("s").alias(f"s{c}")) for c in "uv")
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.where(9 * common >= 4 * (F.size("su") + F.size("sv"))).select("u", "v")


def spanning(comps: np.ndarray, sets: list[np.ndarray], first: int, same: bool) -> list[tuple[int, int]]:
    """Links that join the components of two tiles: rows up to ``first`` against the others (or each other if ``same``)."""
    label, sizes, out = comps.copy(), np.array([len(s) for s in sets]), []
    for x in range(first):
        y = np.arange(x + 1 if same else first, len(sets))
        y = y[(label[y] != label[x]) & (5 * np.minimum(sizes[y], sizes[x]) >= 4 * np.maximum(sizes[y], sizes[x]))]
        if not len(y):
            continue
        own, other = sets[x], np.concatenate([sets[i] for i in y])
        common = np.add.reduceat(own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other, np.cumsum(sizes[y]) - sizes[y], dtype=np.int64)
        for i in y[9 * common >= 4 * (sizes[y] + sizes[x])].tolist():
            if label[i] != label[x]:
                out.append((x, i))
                label[label == label[i]] = label[x]
    return out


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links between different components ``c`` in a bucket ``key`` of ``m`` rows, all its pairs judged in tiles of bounded size."""
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    rows = members.join(_needed(sets, members.select("fp")).hint("merge"), "fp").withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    packed = materialize(rows.groupBy("key", "t").agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct("fp", "c", "s")).alias("b")), "tiles")
    left = packed.select("key", F.col("t").alias("own"), F.col("b").alias("a"), F.explode(F.sequence("t", F.col("tiles") - 1)).alias("t"))
    matched = left.join(packed.select("key", "t", "b").hint("merge"), ["key", "t"]).select("a", "b", F.expr("own = t").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(2)[k].as_py()
                parts = [batch.column(c)[k].values for c in ((0,) if same else (0, 1))]
                fps, comps = (np.concatenate([p.field(name).to_numpy() for p in parts]) for name in ("fp", "c"))
                own = [x.values.to_numpy().view(np.uint32) for p in parts for x in p.field("s")]
                found = spanning(comps, own, len(parts[0]), same)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(fps[[pair[c] for pair in found]]) for c in (0, 1)], ["u", "v"])

    return matched.mapInArrow(run, "u bigint, v bigint").distinct()


def _alike(nodes: DataFrame) -> DataFrame:
    """(u, v): candidates by SimHash, the set ids of a fingerprint with the least of them, and the least ones of fingerprints that are linked."""
    near = fingerprint_links(nodes.select(F.col("sim").alias("fp")).distinct(), RADIUS)
    # Renamed once they are written: a projection right on a co-grouping makes Spark prune what its function reads.
    near = checked_broadcast(materialize(near.distinct(), "near").select(F.col("a").alias("sim"), F.col("b").alias("other")))
    leads = nodes.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("lead"), F.count("*").alias("m"))
    several = checked_broadcast(materialize(leads.where("m > 1").select("sim", "lead"), "leads"))
    copies = nodes.join(several, "sim").select(F.struct("fp", "n").alias("x"), F.col("lead").alias("y"))
    first = leads.join(near, "sim").select(F.col("lead").alias("x"), F.col("other").alias("sim"))
    pairs = copies.union(first.join(leads, "sim").select("x", F.col("lead").alias("y"))).where("x.fp <> y.fp and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)")
    return materialize(pairs.select(F.least("x.fp", "y.fp").alias("u"), F.greatest("x.fp", "y.fp").alias("v")), "pairs")


def links(docs: DataFrame, marked: DataFrame, text_col: str, content: Column) -> DataFrame:
    """(fp, root) of every set id that is in a group of several."""
    nodes = marked.where("bands is not null").groupBy("fp").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("sim").alias("sim"))
    nodes = materialize(nodes, "bands")
    alike = _alike(nodes.select("fp", "n", "sim"))
    banded = nodes.select("fp", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    open_ = materialize(banded.join(checked_broadcast(materialize(shared, "buckets")), "key"), "members")
    wanted = checked_broadcast(materialize(open_.select("fp").union(alike.select(F.explode(F.array("u", "v")))).distinct(), "wanted"))
    held = marked.select("fp", "content").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("content").alias("content")).select("content").distinct()
    held = checked_broadcast(materialize(held, "candidates"))
    texts = docs.select(content.alias("content"), F.col(text_col).cast("string").alias("text")).join(held, "content", "left_semi").select("text")
    sets = materialize(_sets(texts), "sets")

    open_ = open_.select("key", "fp", "n", "m", F.col("fp").alias("c"))
    found = None
    for salt in range(STARS + 1):
        if salt < STARS:
            lead = F.min_by(F.struct("fp", "n", "c"), F.xxhash64("fp", "key", F.lit(salt))).alias("lead")
            leads = checked_broadcast(materialize(open_.groupBy("key").agg(lead), "leads"))
            # 9 common >= 4 (a + b) and common <= min(a, b): sizes further apart can't reach 0.8.
            near = F.least("n", "lead.n") * 5 >= F.greatest("n", "lead.n") * 4
            pairs = open_.join(leads, "key").where(F.col("c") != F.col("lead.c")).where(near)
            pairs = pairs.select(F.least("fp", "lead.fp").alias("u"), F.greatest("fp", "lead.fp").alias("v"))
            new = _confirmed((alike.union(pairs) if found is None else pairs).distinct(), sets)
        else:
            new = _across(open_, sets)
        new = materialize(new, "confirmed")
        found = new if found is None else found.union(new)
        rooted = connected_components(found, "u", "v").withColumnRenamed("node", "fp")
        if salt < STARS:
            placed = open_.drop("c").join(checked_broadcast(rooted), "fp", "left").select("key", "fp", "n", "m", F.coalesce("root", "fp").alias("c"))
            placed = materialize(placed, "placed")
            split = placed.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key")
            open_ = materialize(placed.join(checked_broadcast(materialize(split, "split")), "key", "left_semi"), "open")
            if open_.isEmpty():
                break
    return rooted


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns as they are: the least by id (nulls last), then by content hash."""
    content = F.xxhash64(*docs.columns)
    marked = materialize(marks(docs, id_col, text_col, content), "marks")
    return deduplicate_by(docs, marked.select("doc_id", "content", "fp"), links(docs, marked, text_col, content), id_col, content)
