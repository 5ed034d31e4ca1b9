"""Pearson correlations of many columns at once, by mergeable blocks of co-moments.

A block holds, for every ordered pair (a, b) of columns, over the rows where
both are there: their number, the mean and the squared deviations of a, and the
co-deviations of a and b. A task makes one block with numpy, a batch at a time;
blocks are merged in two rounds on executors. So all pairs take one pass, and
what is shuffled is a block a task, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that are left by the first round of merging.
FAN = 32
FIELDS = ("n", "mean", "square", "cross")
BLOCK = "task int, " + ", ".join(f"{f} array<double>" for f in FIELDS)


@dataclass
class Block:
    """Matrices over pairs (a, b): entry (a, b) of ``mean`` and ``square`` is a's, over the rows that have b too."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Block:
        """Of rows by columns, missing values being NaN."""
        there = ~np.isnan(x)
        n = there.T.astype(float) @ there
        # About a value near the middle, so that the squares don't swamp the deviations.
        filled = np.where(there, x, 0.0)
        pivot = filled.sum(0) / np.maximum(there.sum(0), 1)
        filled = np.where(there, x - pivot, 0.0)
        some = np.maximum(n, 1)
        mean = filled.T @ there / some
        square = (filled**2).T @ there - n * mean**2
        cross = filled.T @ filled - n * mean * mean.T
        return cls(n, np.where(n > 0, mean + pivot[:, None], 0.0), np.maximum(square, 0.0), cross)

    def merged(self, other: Block) -> Block:
        n = self.n + other.n
        some = np.maximum(n, 1)
        gap, weight = other.mean - self.mean, self.n * other.n / some
        # Where one side has no rows, the other's mean is the mean.
        mean = np.where(self.n == 0, other.mean, np.where(other.n == 0, self.mean, self.mean + gap * other.n / some))
        return Block(n, mean, self.square + other.square + gap**2 * weight, self.cross + other.cross + gap * gap.T * weight)

    def correlations(self) -> np.ndarray:
        """Entry (a, b), NaN where either column doesn't vary or rows are lacking."""
        product = np.sqrt(self.square * self.square.T)
        varies = (self.n > 1) & (product > 0)
        return np.where(varies, np.clip(self.cross / np.where(varies, product, 1.0), -1.0, 1.0), np.nan)

    def row(self, task: int) -> pa.Table:
        return pa.table({"task": pa.array([task], pa.int32())} | {f: pa.array([getattr(self, f).ravel()], pa.list_(pa.float64())) for f in FIELDS})


def _merge(table: pa.Table, size: int) -> Block:
    """All blocks of a table, in the order of their tasks."""
    table = table.sort_by("task")
    blocks = [Block(*(np.array(table[f][i].as_py()).reshape(size, size) for f in FIELDS)) for i in range(len(table))]
    whole = blocks[0]
    for block in blocks[1:]:
        whole = whole.merged(block)
    return whole


def correlations(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(a, b, corr): Pearson over the rows where both are there, all ordered pairs and the diagonal, in one pass.

    Nulls and NaN are missing. A pair of which either side doesn't vary, or
    without two rows, has a null; so has every pair of an empty table.
    """
    names = list(metrics)
    size = len(names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Block(*(np.zeros((size, size)) for _ in FIELDS))
        for batch in batches:
            if len(batch):
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
                whole = whole.merged(Block.of(x))
        yield from whole.row(TaskContext.get().partitionId()).to_batches()

    def fold(table: pa.Table) -> pa.Table:
        return _merge(table, size).row(table["task"][0].as_py() % FAN)

    def finish(table: pa.Table) -> pa.Table:
        r = _merge(table, size).correlations().ravel()
        pairs = [(a, b) for a in names for b in names]
        return pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "corr": pa.array(r, pa.float64(), mask=np.isnan(r))})

    blocks = df.select(*(F.col(m).cast("double").alias(m) for m in names)).mapInArrow(make, BLOCK)
    # A block of no rows, so that an empty table has its pairs, too.
    nothing = df.sparkSession.range(1).select(F.lit(FAN).alias("task"), *(F.array_repeat(F.lit(0.0), size * size).alias(f) for f in FIELDS))
    some = blocks.union(nothing).groupBy(F.col("task") % FAN).applyInArrow(fold, BLOCK)
    return some.groupBy().applyInArrow(finish, "a string, b string, corr double")  # FAN blocks at most
