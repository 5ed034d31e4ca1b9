"""Places, running totals and digests of rows in groups of any size.

A group here (a conversation, the members of a trie node) may hold a third of
all rows, so none of these helpers needs a group in one task: rows are dealt by
ranges of (key, order), worked on inside their range or piece, and what earlier
ranges add up to comes from a table of totals. Only SHA-256, which can't be
divided, takes a group's text through one task, as a stream of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scratch import materialize

#: Characters that one piece of a joined text holds, about.
PIECE_CHARS = 1 << 20
#: Digests in one batch of results.
BATCH = 10_000


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def placed(rows: DataFrame, key: str, order: Sequence[Column], name: str, weight: Column | None = None) -> DataFrame:
    """``rows`` with ``before``: the weights (1 each, if none are given) of the rows before it among those of equal key.

    Rows are dealt by ranges of (key, order). A key is in several ranges only
    if it is the first of one and the last of one, so the offsets of such keys
    are two rows a range at most: a proven bound for their broadcast.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    dealt = rows.withColumn("_w", weight).repartitionByRange(parts_of(rows), F.col(key).asc_nulls_first(), *order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), name)
    edges = dealt.groupBy("_range").agg(F.min(F.struct(key)).alias("lo"), F.max(F.struct(key)).alias("hi"))
    spanning = edges.select(F.col(f"lo.{key}").alias("_k")).intersect(edges.select(F.col(f"hi.{key}").alias("_k")))
    totals = dealt.join(F.broadcast(spanning), F.col(key).eqNullSafe(F.col("_k"))).groupBy("_k", "_range").agg(F.sum("_w").alias("_n"))
    earlier = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_k", F.col("_range").alias("_r"), F.sum("_n").over(earlier).alias("_offset"))
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    joined = local.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")), "left")
    return joined.withColumn("before", F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).drop("_w", "_range", "_local", "_k", "_r", "_offset")


def _streamed(df: DataFrame, columns: list[str], schema: str, run: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``run`` over the rows of each sorted partition, as one stream; fields that aren't columns of ``df`` are strings, the last one the longest."""
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kinds.update(zip(columns, batch.schema.types, strict=True))
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*out, strict=True), names, strict=True)], names)

        out: list[tuple] = []
        size = 0
        for row in run(rows()):
            out.append(row)
            size += len(row[-1])
            if size >= 4 * PIECE_CHARS or len(out) >= BATCH:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return df.select(*columns).mapInArrow(work, schema)


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def joined_sha256(items: DataFrame, keys: Sequence[str], order: str, item: str, separator: str, name: str = "sha256") -> DataFrame:
    """(keys, ``name``): lowercase SHA-256 hex of each key's items in order, joined; items of equal key and order count once.

    Items are joined into pieces of a megabyte within ranges of (keys, order);
    a key's pieces then stream through one digest. No list of items is held.
    """
    keys = list(keys)

    def join(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, first, last, parts, size = None, None, None, [], 0
        for *k, at, value in rows:
            if k == key and at == last:
                continue
            if parts and (k != key or size >= PIECE_CHARS):
                yield (*key, first, separator.join(parts))
                parts, size = [], 0
            if not parts:
                key, first = k, at
            last = at
            parts.append(value)
            size += len(value) + 1
        if parts:
            yield (*key, first, separator.join(parts))

    dealt = items.repartitionByRange(parts_of(items), *keys, order).sortWithinPartitions(*keys, order)
    pieces = _streamed(dealt, [*keys, order, item], f"{_schema(items, [*keys, order])}, body string", join)
    met = pieces.repartition(parts_of(items), *keys).sortWithinPartitions(*keys, order)
    return sha256_in_order(met, keys, "body", separator, name)


def sha256_in_order(items: DataFrame, keys: Sequence[str], item: str, separator: str, name: str = "sha256") -> DataFrame:
    """(keys, ``name``) of items that are dealt by the keys already and lie in order in each partition; nothing is shuffled."""

    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, sha = None, None
        for *k, body in rows:
            if k == key:
                sha.update(separator.encode())
            else:
                if sha:
                    yield (*key, sha.hexdigest())
                key, sha = k, hashlib.sha256()
            sha.update(body.encode())
        if sha:
            yield (*key, sha.hexdigest())

    return _streamed(items, [*keys, item], f"{_schema(items, keys)}, {name} string", digest)
