"""Logistic regression by stochastic gradient descent, distributed over shards of rows.

Rows are dealt into shards by a seeded hash, and a shard's rows lie in the order
of that hash, cut into batches. In an epoch every shard starts from the same
coefficients and takes one step a row at a constant rate, with an L2 penalty,
its batches in order and the rows of each in an order drawn for (seed, epoch,
shard, batch). The shards' coefficients are then averaged by their rows. So the
result depends on the rows, the seed and the size of a shard, not on the cluster.

An epoch is one pass: rows are scored with the coefficients that come in, which
gives the epoch before its history, and the training rows then move them. Only
sums leave the shards, folded on executors before ``FAN`` rows reach the driver.

More than two classes are trained one against the rest, their probabilities
scaled to one. The intercept moves at ``INTERCEPT`` times the rate, as is usual
for sparse features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import small_batches

#: Share of the rate at which the intercept moves.
INTERCEPT = 0.01
#: Rows of sums that reach the driver, and copies of a row that are dealt out at a time.
FAN, RUN = 16, 4096
SIDES = ("train", "test")
#: Probabilities are kept this far from 0 and 1 in the loss.
EPSILON = float(np.finfo(np.float64).eps)
SUMS = "shard int, n bigint, w array<double>, b array<double>, hits array<bigint>, loss array<double>"


@dataclass(frozen=True)
class Settings:
    """Training parameters; ``shard_rows`` is how many rows a shard holds on average."""

    epochs: int = 5
    rate: float = 0.001
    reg: float = 1e-4
    batch: int = 128
    seed: int = 13
    shard_rows: int = 50_000


def sparse(vector: Column) -> Column:
    """A vector column's (indices, values), dense ones with all their places."""
    held = F.unwrap_udt(vector)
    dense = F.coalesce(held["size"], F.size(held["values"]))
    places = F.when(dense > 0, F.sequence(F.lit(0), dense - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.coalesce(held["indices"], places).alias("indices"), held["values"].alias("values"))


def dealt(rows: DataFrame, settings: Settings, total: int) -> DataFrame:
    """``rows`` of (id, side, y, indices, values) in shards: (shard, side, h, y, indices, values), sorted within partitions.

    Equal rows are counted first and dealt out again by their number, so a row
    that recurs is spread over all shards.
    """
    shards = max(1, -(-total // settings.shard_rows))
    kinds = rows.groupBy("id", "side", "y").agg(F.first("indices").alias("indices"), F.first("values").alias("values"), F.count("*").alias("copies"))
    runs = kinds.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(RUN).cast("bigint"))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("copies")) - 1)))
    order = F.md5(F.concat_ws(":", F.lit(str(settings.seed)), F.col("id").cast("string"), F.col("copy").cast("string")).cast("binary"))
    placed = each.withColumn("h", order).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    return placed.select("shard", "side", "h", "y", "indices", "values").repartition(shards, "shard").sortWithinPartitions("shard", "side", "h")


@dataclass
class Batch:
    """Sparse rows of one shard and side."""

    ends: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Batch:
        ends = np.cumsum([0, *(len(r[1]) for r in rows)])
        flat = lambda k, kind: np.fromiter((x for r in rows for x in r[k]), kind, int(ends[-1]))
        return cls(ends, flat(1, np.int64), flat(2, np.float64), np.array([r[0] for r in rows], np.int64))

    def probabilities(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(self.y)), np.diff(self.ends))
        z = np.stack([np.bincount(row, k[self.indices] * self.values, len(self.y)) for k in w], 1) + b
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        if len(w) == 1:
            return np.concatenate([1 - p, p], 1)
        whole = p.sum(1, keepdims=True)
        return np.where(whole > 0, p / np.where(whole > 0, whole, 1), 1 / len(w))


class Shard:
    """The coefficients of one shard on their way through an epoch."""

    def __init__(self, w: np.ndarray, b: np.ndarray, settings: Settings) -> None:
        self.w, self.b, self.scale, self.n = w.copy(), b.copy(), 1.0, 0
        self.settings = settings

    def learn(self, batch: Batch, order: np.ndarray) -> None:
        """A step a row; the penalty shrinks a common factor instead of all coefficients."""
        rate, shrink = self.settings.rate, 1 - self.settings.rate * self.settings.reg
        truth = batch.y[:, None] == (np.arange(len(self.w)) if len(self.w) > 1 else np.array([1]))
        for i in order:
            at = slice(batch.ends[i], batch.ends[i + 1])
            columns, x = batch.indices[at], batch.values[at]
            z = self.scale * (self.w[:, columns] @ x) + self.b
            step = rate * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - truth[i])
            self.scale *= shrink
            self.w[:, columns] -= np.outer(step / self.scale, x)
            self.b -= INTERCEPT * step
        self.n += len(order)
        if self.scale < 1e-9:
            self.settle()

    def settle(self) -> np.ndarray:
        self.w *= self.scale
        self.scale = 1.0
        return self.w


def _epoch(held: DataFrame, w: np.ndarray, b: np.ndarray, classes: int, settings: Settings, epoch: int, learn: bool) -> dict:
    """The sums of one pass: averaged coefficients, confusion counts and losses by side."""
    spark = held.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((w, b))
    names = ["shard", "n", "w", "b", "hits", "loss"]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[tuple]]]:
        """Batches of one shard and side, in order."""
        key, rows = None, []
        for batch in batches:
            for shard, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and ((shard, side) != key or len(rows) == settings.batch):
                    yield (*key, rows)
                    rows = []
                key = (shard, side)
                rows.append(row)
        if rows:
            yield (*key, rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w0, b0 = shared.value
        at, state, hits, loss, number = None, None, None, None, 0

        def row() -> pa.RecordBatch:
            values = ([at], [state.n], [state.settle().ravel()], [state.b], [hits.ravel()], [loss])
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for shard, side, rows in slices(batches):
            if shard != at:
                if at is not None:
                    yield row()
                at, state, hits, loss, number = shard, Shard(w0, b0, settings), np.zeros((2, classes, classes), np.int64), np.zeros(2), 0
            batch, s = Batch.of(rows), SIDES.index(side)
            p = batch.probabilities(w0, b0)
            np.add.at(hits[s], (batch.y, p.argmax(1)), 1)
            loss[s] += -math.fsum(np.log(np.clip(p[np.arange(len(rows)), batch.y], EPSILON, 1 - EPSILON)))
            if learn and side == "train":
                state.learn(batch, np.random.default_rng([settings.seed, epoch, shard, number]).permutation(len(rows)))
                number += 1
        if at is not None:
            yield row()

    def fold(group: pa.Table) -> pa.Table:
        """One row of a group's sums, coefficients weighted by rows, added in the order of shards."""
        group = group.sort_by("shard")
        n = group["n"].to_numpy()
        total = lambda name: sum(np.asarray(x) * k for x, k in zip(group[name].to_pylist(), n, strict=True))
        plain = lambda name: sum(np.asarray(x) for x in group[name].to_pylist())
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "w": [total("w")], "b": [total("b")], "hits": [plain("hits")], "loss": [plain("loss")]})

    sums = held.select("shard", "side", "y", "indices", "values").mapInArrow(work, SUMS)
    parts = sorted(sums.groupBy(F.col("shard") % FAN).applyInArrow(fold, SUMS).collect(), key=lambda r: r.shard)  # FAN rows at most
    shared.destroy()
    add = lambda name: sum(np.array(r[name]) for r in parts)
    n = sum(r.n for r in parts)
    return {"w": (add("w") / max(n, 1)).reshape(w.shape), "b": add("b") / max(n, 1), "hits": add("hits").reshape(2, classes, classes), "loss": add("loss")}


def scores(hits: np.ndarray, loss: float) -> dict[str, float]:
    """Accuracy, F1 weighted by support, and mean log loss, of a confusion matrix (truth by prediction)."""
    n, support, right = hits.sum(), hits.sum(1), np.diag(hits)
    if not n:
        return {"accuracy": math.nan, "f1": math.nan, "log_loss": math.nan}
    both = support + hits.sum(0)
    f1 = np.where(both > 0, 2 * right / np.where(both > 0, both, 1), 0.0)
    return {"accuracy": float(right.sum() / n), "f1": float((f1 * support).sum() / n), "log_loss": float(loss / n)}


def fit(rows: DataFrame, features: int, classes: int, settings: Settings = Settings()) -> tuple[SgdModel, list[dict]]:  # noqa: B008
    """(model, history by epoch) of rows of (id, side, y, indices, values); only those of the side ``train`` are learnt from.

    Defined results: rows without features move the intercept alone; equal rows
    count as often as they occur; without test rows their scores are NaN. One
    class, or no training rows, is an error.
    """
    if classes < 2:
        raise ValueError("a classifier takes two classes or more")
    held = dealt(rows, settings, rows.count()).persist(StorageLevel.DISK_ONLY)
    try:
        w = np.zeros((1 if classes == 2 else classes, features))
        b, history = np.zeros(len(w)), []
        for epoch in range(settings.epochs + 1):
            sums = _epoch(held, w, b, classes, settings, epoch, epoch < settings.epochs)
            if not sums["hits"][0].sum():
                raise ValueError("no rows to learn from")
            if epoch:
                named = {f"{name}_{k}": v for name, hits, loss in zip(("train", "val"), sums["hits"], sums["loss"], strict=True) for k, v in scores(hits, loss).items()}
                history.append({"epoch": epoch} | named)
            if epoch < settings.epochs:
                w, b = sums["w"], sums["b"]
    finally:
        held.unpersist()
    return SgdModel(coefficients=w.ravel().tolist(), intercepts=b.tolist()), history


class SgdModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction`` and ``probability`` to a table with a vector column of features."""

    coefficients = Param(Params._dummy(), "coefficients", "a row a class (one for two classes), one after another", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "one a class (one for two classes)", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, coefficients: list[float] | None = None, intercepts: list[float] | None = None) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", probabilityCol="probability")
        self._set(**self._input_kwargs)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        b = np.array(self.getOrDefault(self.intercepts))
        return np.array(self.getOrDefault(self.coefficients)).reshape(len(b), -1), b

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.arrays())

        @F.arrow_udf("array<double>")
        def probabilities(indices: pa.Array, values: pa.Array) -> pa.Array:
            rows = [(0, i or [], v or []) for i, v in zip(indices.to_pylist(), values.to_pylist(), strict=True)]
            p = Batch.of(rows).probabilities(*shared.value) if rows else np.empty((0, 2))
            return pa.array(list(p), pa.list_(pa.float64()))

        parts = sparse(F.col(self.getFeaturesCol()))
        p, out = self.getProbabilityCol(), df.withColumn("__p", probabilities(parts["indices"], parts["values"]))
        # The first of the most probable classes.
        best = F.array_position("__p", F.array_max("__p")).cast("double") - 1
        return out.withColumn(self.getPredictionCol(), best).withColumn(p, array_to_vector("__p")).drop("__p")
