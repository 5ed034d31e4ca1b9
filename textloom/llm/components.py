"""Connected components of a link table, by alternating star contractions.

The two operations are the large-star and small-star of Kiveris et al.,
"Connected Components in MapReduce and Beyond" (2014). Links stay distributed;
only a row count and a checksum reach the driver per round. A round over SMALL
links or fewer is one task and one job, as a shuffle of few rows costs the driver
as much as one of many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scratch import checked_broadcast, materialize

#: Links (of 16 bytes) that a round takes in one task, at most.
SMALL = 200_000


def _least_neighbour(links: DataFrame) -> DataFrame:
    """(u, m): a row a node, broadcast while there are few, so that a node with many links isn't one task of a join."""
    return checked_broadcast(materialize(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the node's least neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the least of them."""
    least = _least_neighbour(links)
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _stars_of_few(links: DataFrame) -> DataFrame:
    """Both contractions of SMALL links at most, within one partition, so that nothing is shuffled."""
    near = Window.partitionBy("u")
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = links.coalesce(1).select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))
    large = both.withColumn("m", F.least(F.min("v").over(near), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = large.withColumn("m", F.min("v").over(near)).select(F.inline(F.array(pair("v", "m"), pair("u", "m"))))
    return small.where("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Return (node, root) for every linked node; root is the least node it reaches.

    ``a`` and ``b`` name two bigint columns. Nulls and self-links are ignored,
    repeated links count once; an empty table gives an empty result.
    """
    current = materialize(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    mark = None
    for _ in range(max_rounds):
        row = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row.n, row.x) == mark or not row.n:
            break
        mark = (row.n, row.x)
        current = materialize(_stars_of_few(current) if row.n <= SMALL else _small_star(_large_star(current).distinct()).distinct(), "links")
    else:
        raise RuntimeError("connected components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
