"""Exact top-k inner-product search with dual cover trees.

Each side is indexed by a cover tree: a node's children are centres picked
farthest first among its points, so every centre is at least as far from the
others as the children's covering radius (separation), every point is within
its child's radius (covering), and the node's own centre is its first child
(nesting). Nodes carry explicit covering radii. For a pair of nodes with
centres q, c and radii r, s no inner product exceeds

    <q, c> + r |c| + s |q| + r s

and the pair is pruned if that is below the worst kth score in the query node.

Across the cluster the same test runs on the top level: vectors belong to the
cell of their nearest pivot, and only cells that some query group can't exclude
are sent that group. There are as many pivots as blocks, so a cell is a block
with a radius of its own, until the sample is used up; larger cells are split by
hash into blocks of bounded size. A bounded sample gives the pivots and every
query's first bound; no result depends on it.

Equal vectors are one point with their k + 1 least ids, which suffice for any
top k without the query itself. Components are quantised to floor(scale * x),
held as doubles, which they fit exactly. Where products and sums stay below 2^52
a double holds them, too; beyond that scores are computed in integers of any
size. A score among a query's best that a long can't hold, or just so,
raises an error; so does a component whose multiple by the scale is no double.

Defined results: vectors that are null or hold null or non-finite components,
and rows without id, take no part; a vector is compared with those of its own
length; repeated rows count once; ties go to the smaller id; an empty table gives
no rows. Vectors of any length count whole. Only the two named columns are read,
so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bytewords import flat
from textloom.llm.scratch import checked_broadcast, materialize

SAMPLE = 2048
#: Points of one block, queries of one tile, points of a leaf, children of a node.
BLOCK, TILE, LEAF, FAN = 2048, 1024, 48, 8
#: Relative slack for rounding in the bounds.
SLACK = 1e-9
#: Stands for no point; its negative is a long, too. Below any integer score of two vectors of doubles.
EMPTY, NONE = -(1 << 62), -(1 << 4096)
LEAST_LONG = -(1 << 63)
#: Query trees that a task keeps at hand.
HELD_TREES = 32


def farthest_first(points: np.ndarray, first: int, limit: int, radius: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(centres, nearest centre of each point, distance to it); stops once all are within ``radius``."""
    chosen, owner = [first], np.zeros(len(points), np.int64)
    distance = np.linalg.norm(points - points[first], axis=1)
    while len(chosen) < limit and distance.max() > radius:
        new = int(distance.argmax())
        other = np.linalg.norm(points - points[new], axis=1)
        closer = other < distance
        owner[closer], distance[closer] = len(chosen), other[closer]
        chosen.append(new)
    return chosen, owner, distance


@dataclass
class Tree:
    """A cover tree over rows of ``points``, which are in ``order``; node 0 is the root."""

    points: np.ndarray
    order: np.ndarray = field(init=False)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        centres: list[np.ndarray] = []
        self.order = np.arange(len(self.points))

        def add(start: int, end: int, centre: np.ndarray, radius: float) -> int:
            self.start.append(start)
            self.end.append(end)
            self.radius.append(radius)
            self.children.append(np.empty(0, np.int64))
            centres.append(centre)
            return len(centres) - 1

        whole = np.linalg.norm(self.points - self.points[0], axis=1)
        todo = [(add(0, len(self.points), self.points[0], float(whole.max())), 0)]
        while todo:
            node, centre = todo.pop()
            start, end = self.start[node], self.end[node]
            if end - start <= LEAF or self.radius[node] == 0:
                continue
            own = self.order[start:end].copy()
            part = self.points[own]
            chosen, owner, distance = farthest_first(part, int(np.flatnonzero(own == centre)[0]), FAN, self.radius[node] / 2)
            by = np.argsort(owner, kind="stable")
            self.order[start:end] = own[by]
            sizes = np.bincount(owner, minlength=len(chosen))
            below, at = [], start
            for k, size in enumerate(sizes):
                below.append(add(at, at + int(size), part[chosen[k]], float(distance[owner == k].max())))
                todo.append((below[-1], int(own[chosen[k]])))
                at += int(size)
            self.children[node] = np.array(below)
        self.centre = np.array(centres)
        self.norm = np.linalg.norm(self.centre, axis=1)
        self.reach = np.array(self.radius)
        self.points = self.points[self.order]

    def below(self, node: int) -> np.ndarray:
        return self.children[node] if len(self.children[node]) else np.array([node])

    def is_leaf(self, node: int) -> bool:
        return not len(self.children[node])


def _float_below(x: int) -> float:
    """A double that is not above an integer of any size."""
    try:
        return float(np.nextafter(float(x), -np.inf))
    except OverflowError:
        return np.finfo(np.float64).max if x > 0 else -np.inf


@dataclass
class Visits:
    """What a search did: leaf pairs met and those there are."""

    leaves: int = 0
    possible: int = 0


def search(queries: Tree, floor: np.ndarray, points: Tree, rank: np.ndarray, k: int, visits: Visits | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, positions): each query's k best points, positions -1 where there is none.

    Rows are in the trees' own order of queries, positions in the points' input
    order. ``floor`` holds scores that a query's kth best is known to reach;
    ties in score go to the smaller ``rank``. Scores are longs, or Python
    integers where doubles might not hold them.
    """
    n, m = len(queries.points), len(points.points)
    with np.errstate(over="ignore", invalid="ignore"):
        largest = max(np.abs(queries.points).max(initial=0), 1) * max(np.abs(points.points).max(initial=0), 1) * max(1, queries.points.shape[1])
        exact = bool(largest < 2**52 and largest * m < 2**61)
    of = (lambda x: x) if exact else (lambda x: np.array([int(c) for c in x.ravel()], object).reshape(x.shape))
    none = EMPTY if exact else NONE
    whole_q, whole_p = of(queries.points), of(points.points)
    best = np.full((n, k), none, None if exact else object)  # score * m + (m - 1 - rank)
    worst = floor[queries.order].astype(np.float64)
    tie = (m - 1 - rank[points.order]).astype(np.int64 if exact else object)
    at_rank = np.empty(m, np.int64)
    at_rank[m - 1 - rank] = np.arange(m)
    if visits:
        visits.possible += sum(map(queries.is_leaf, range(len(queries.start)))) * sum(map(points.is_leaf, range(len(points.start))))
    todo = [(0, 0, np.inf)]
    while todo:
        q, c, bound = todo.pop()
        qs, qe = queries.start[q], queries.end[q]
        if bound < worst[qs:qe].min():
            continue
        if queries.is_leaf(q) and points.is_leaf(c):
            if visits:
                visits.leaves += 1
            cs, ce = points.start[c], points.end[c]
            score = whole_q[qs:qe] @ whole_p[cs:ce].T
            rows = np.flatnonzero((score >= worst[qs:qe, None]).any(axis=1))
            if len(rows):
                new = score[rows].astype(np.int64) if exact else score[rows]
                both = np.concatenate([best[qs + rows], new * m + tie[cs:ce]], axis=1)
                if both.shape[1] > k:
                    both = -np.partition(-both, k - 1, axis=1)[:, :k] if exact else -np.sort(-both, axis=1)[:, :k]
                best[qs + rows] = both
                kth = best[qs + rows].min(axis=1)
                reached = kth // m if exact else np.array([_float_below(int(x) // m) for x in kth])
                worst[qs + rows] = np.maximum(worst[qs + rows], np.where(kth == none, -np.inf, reached).astype(np.float64))
            continue
        qb, cb = queries.below(q), points.below(c)
        r, s = queries.reach[qb][:, None], points.reach[cb][None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            most = queries.centre[qb] @ points.centre[cb].T + r * points.norm[cb][None, :] + s * queries.norm[qb][:, None] + r * s
            most += SLACK * (1 + np.abs(most) + queries.norm[qb][:, None] * points.norm[cb][None, :]) + 1e-6
        most[np.isnan(most)] = np.inf
        for i in np.argsort(most, axis=None):
            todo.append((int(qb[i // len(cb)]), int(cb[i % len(cb)]), float(most.flat[i])))
    best = -np.sort(-best, axis=1)
    empty = best == none
    return np.where(empty, 0, best // m), np.where(empty, -1, at_rank[np.where(empty, 0, best % m).astype(np.int64)])


def unpack(values: pa.Array) -> np.ndarray:
    """Rows of equal length packed as little-endian doubles."""
    data, _ = flat(values)
    return np.frombuffer(data.tobytes(), "<f8").astype(np.float64).reshape(len(values), -1) if len(values) else np.empty((0, 0))


def quantised(x: Sequence[float], scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.floor(scale * np.array(x, np.float64)) + 0.0  # one zero
    if not np.isfinite(out).all():
        raise OverflowError("a component times the scale is out of a double's range")
    return out.astype("<f8")


def as_longs(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; those out of range become the least or the largest."""
    return np.array([min(max(int(x), LEAST_LONG), ~LEAST_LONG) for x in scores], np.int64) if scores.dtype == object else scores


def encode(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, dim, v): quantised vectors that take part, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # All components of the batch at once; a vector's bytes are a slice of theirs.
            x = quantised(batch.column(1).flatten().to_numpy(), scale)
            dims = batch.column(1).value_lengths().to_numpy().astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(dims, dtype=np.int32) * 8]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(dims), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), packed], ["vec_id", "dim", "v"])

    finite = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    chosen = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return chosen.where("vec_id is not null and x is not null").where(finite).mapInArrow(run, "vec_id bigint, dim int, v binary")


@dataclass
class Top:
    """The broadcast top level, of bounded size: by dimension, pivots and sample vectors."""

    pivots: dict[int, np.ndarray]
    sample: dict[int, np.ndarray]
    #: (dim, cell): (blocks, covering radius, largest norm)
    cells: dict[tuple[int, int], tuple[int, float, float]] = field(default_factory=dict)

    def locate(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pivots = self.pivots.get(dim, np.zeros((1, dim)))
        with np.errstate(over="ignore", invalid="ignore"):
            cell = ((pivots**2).sum(1)[None, :] - 2 * x @ pivots.T).argmin(axis=1)
        return cell, np.linalg.norm(x - pivots[cell], axis=1)

    def floors(self, dim: int, x: np.ndarray, k: int) -> np.ndarray:
        """Scores that the kth best of each query reaches in the sample alone."""
        sample = self.sample.get(dim, np.zeros((0, dim)))
        if len(sample) < k:
            return np.full(len(x), -np.finfo(np.float64).max)
        with np.errstate(over="ignore", invalid="ignore"):
            kth = -np.partition(-(x @ sample.T), k - 1, axis=1)[:, k - 1]
            kth -= SLACK * np.linalg.norm(x, axis=1) * np.linalg.norm(sample, axis=1).max() + 1e-6
        return np.where(np.isfinite(kth), kth, -np.finfo(np.float64).max)

    def reachable(self, dim: int, cell: int, radius: float, norm: float, floor: float) -> list[tuple[int, int]]:
        """(cell, blocks) of the cells that may hold a score of ``floor`` for a group of queries."""
        pivots = self.pivots.get(dim, np.zeros((1, dim)))
        out = []
        for (d, c), (blocks, reach, longest) in self.cells.items():
            if d == dim:
                q, p = pivots[cell], pivots[c]
                with np.errstate(over="ignore", invalid="ignore"):
                    most = min(norm * longest, q @ p + radius * np.linalg.norm(p) + reach * np.linalg.norm(q) + radius * reach)
                    apart = most + SLACK * (1 + abs(most) + norm * longest) + 1e-6 < floor
                if not apart:
                    out.append((c, blocks))
        return out


def _by_dim(batch: pa.RecordBatch, run) -> list[np.ndarray]:
    """Apply ``run(dim, matrix)`` to the rows of each dimension; its arrays, back in row order."""
    dims = batch.column("dim").to_numpy()
    out: list[np.ndarray] = []
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        got = run(int(dim), unpack(batch.column("v").take(pa.array(at))))
        out = out or [np.zeros(len(dims), a.dtype) for a in got]
        for whole, part in zip(out, got, strict=True):
            whole[at] = part
    return out


def top_k(rows: DataFrame, is_query: F.Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of which ``is_query`` (over ``vec_id``) holds."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    keep = k + 1
    encoded = materialize(encode(rows, id_col, vector_col, scale), "vectors")
    ranked = encoded.withColumn("r", F.dense_rank().over(Window.partitionBy("dim", "v").orderBy("vec_id"))).where(F.col("r") <= keep)
    classes = materialize(ranked.groupBy("dim", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "classes")
    sample: dict[int, list[np.ndarray]] = {}
    for r in classes.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(r.dim, []).append(np.frombuffer(r.v, "<f8"))
    drawn = {d: np.array(x).reshape(len(x), d) for d, x in sample.items()}
    cells_wanted = -(-classes.count() // BLOCK)
    top = Top({d: x[farthest_first(x, 0, max(1, cells_wanted), 0.0)[0]] for d, x in drawn.items()}, drawn)
    shared = sc.broadcast(top)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, radius, norm = _by_dim(batch, lambda d, x: [*shared.value.locate(d, x), np.linalg.norm(x, axis=1)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(norm)], [*batch.schema.names, "cell", "radius", "norm"])

    located = materialize(classes.mapInArrow(locate, "dim int, v binary, ids array<bigint>, cell int, radius double, norm double"), "located")
    stats = located.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect()
    cells = {(r.dim, r.cell): (-(-r.n // BLOCK), r.radius, r.norm) for r in stats}
    planned = sc.broadcast(Top(top.pivots, top.sample, cells))
    counts = spark.createDataFrame([(d, c, n) for (d, c), (n, _, _) in cells.items()] or [(0, 0, 1)], "dim int, cell int, blocks int")
    split = located.join(checked_broadcast(counts), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    blocks = split.groupBy("dim", "cell", "block").agg(F.collect_list(F.struct("v", "ids")).alias("points"))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = _by_dim(batch, lambda d, x: [*planned.value.locate(d, x), np.linalg.norm(x, axis=1), planned.value.floors(d, x, keep)])
                cell, radius, norm, floor = values
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(norm), pa.array(floor)],
                    [*batch.schema.names, "cell", "radius", "norm", "floor"],
                )

    asked = encoded.where(is_query)
    aimed = asked.select("dim", "v").distinct().mapInArrow(aim, "dim int, v binary, cell int, radius double, norm double, floor double")
    aimed = materialize(aimed, "queries")
    sizes = aimed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiles = (
        aimed.join(checked_broadcast(sizes), ["dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int"))
        .groupBy("dim", "cell", "tile")
        .agg(F.collect_list(F.struct("v", "floor")).alias("queries"), F.max("radius").alias("radius"), F.max("norm").alias("norm"), F.min("floor").alias("floor"))
        .withColumn("tile_id", F.monotonically_increasing_id())
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, cell, radius, norm, floor, tile = (batch.column(c)[i].as_py() for c in range(6))
                for other, n in planned.value.reachable(dim, cell, radius, norm, floor):
                    one = batch.column(6).slice(i, 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim] * n, pa.int32()), pa.array([other] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([tile] * n, pa.int64()), pa.concat_arrays([one] * n)],
                        ["dim", "cell", "block", "tile", "queries"],
                    )

    parts = max(sc.defaultParallelism, min(sum(n for n, _, _ in cells.values()), 20_000))
    sent = tiles.select("dim", "cell", "radius", "norm", "floor", "tile_id", "queries").mapInArrow(
        send, "dim int, cell int, block int, tile bigint, queries array<struct<v: binary, floor: double>>"
    )
    key = ["dim", "cell", "block"]
    met = sent.repartition(parts, *key).join(blocks.repartition(parts, *key).hint("merge"), key)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, tree, ids, rank = None, None, [], np.empty(0, np.int64)
        held: dict[int, tuple[Tree, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                own = tuple(batch.column(c)[i].as_py() for c in range(3))
                if own != built:
                    points = batch.column(5)[i].values
                    ids = points.field("ids").to_pylist()
                    rank = np.empty(len(ids), np.int64)
                    rank[np.argsort([x[0] for x in ids], kind="stable")] = np.arange(len(ids))
                    built, tree = own, Tree(unpack(points.field("v")))
                tile, asked = batch.column(3)[i].as_py(), batch.column(4)[i].values
                if tile not in held:
                    if len(held) >= HELD_TREES:
                        held.pop(next(iter(held)))
                    held[tile] = Tree(unpack(asked.field("v"))), asked.field("floor").to_numpy(zero_copy_only=False)
                queries, floor = held[tile]
                score, at = search(queries, floor, tree, rank, keep)
                row, column = np.nonzero((at >= 0) & (score >= floor[queries.order][:, None]))
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [asked.field("v").take(pa.array(queries.order[row])), pa.array(as_longs(score[row, column]), pa.int64()), pa.array([ids[p] for p in at[row, column]], pa.list_(pa.int64()))],
                        ["v", "score", "ids"],
                    )

    found = met.select("dim", "cell", "block", "tile", "queries", "points").mapInArrow(find, "v binary, score bigint, ids array<bigint>")
    nearest = found.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("r") <= keep)
    # keep classes of keep ids each at most, so the lists are bounded.
    listed = (
        nearest.select("v", "score", F.explode("ids").alias("vec_id"))
        .groupBy("v")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id"))), 1, keep).alias("best"))
    )
    answers = asked.select("vec_id", "v").distinct().withColumnRenamed("vec_id", "query_id").join(listed, "v")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = answers.select("query_id", F.posexplode(others).alias("pos", "x"))
    score = F.bitwise_not("x.s")
    edge = score.isin(LEAST_LONG, ~LEAST_LONG)
    checked = F.when(edge, F.raise_error(F.lit("an inner product is out of a long's range")).cast("bigint")).otherwise(score)
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), checked.alias("score"))


def op1_top5(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 50 == 0)


ORACLE = """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
               FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
