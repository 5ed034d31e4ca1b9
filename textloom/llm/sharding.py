"""Sharding by rendezvous hashing over weighted shards, with DataFrame functions only.

Every shard draws a score from the record key; the highest wins. With u the
key's uniform draw for a shard of weight w, the score is -w / ln(u), so a shard
wins a share of keys in proportion to its weight, and a new shard takes rows
only into itself.

Texts are read once, for a narrow table of id, size and CRC-32 in which equal
rows are one row with a count.

Defined results: a null key draws like the empty string, and a null text is
empty; repeated rows share a shard and get slots of their own; a text counts
whole, however long; ties in score go to the smaller shard; an empty table gives
no rows. Columns are read by name into new names, so columns of the input can't
clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scratch import materialize

#: Hex digits of a row's hash that give its bucket; a shard's rows are numbered by bucket, so no task holds a whole shard.
BUCKET_DIGITS = 3
#: Copies of one row that are numbered by one generated row.
RUN = 4096


def draw(key: Column, shard: int) -> Column:
    """A uniform draw in (0, 1) from the first 52 bits of an MD5 of key and shard."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(2**52)


def _bids(key: Column, weights: Sequence[float], first: int = 0) -> list[Column]:
    if min(weights, default=0) <= 0:
        raise ValueError("weights must be positive")
    return [F.struct((F.lit(-float(w)) / F.log(draw(key, i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights, first)]


def _best(bids: Sequence[Column]) -> Column:
    return F.greatest(*bids) if len(bids) > 1 else bids[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (an int) that a string key falls to; ties go to the smaller shard."""
    return (-_best(_bids(key, weights))["shard"]).cast("int")


def shard_rows(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) for every row.

    ``grown`` holds the weights with further shards appended; ``grown_shard`` is
    the shard under them. Slots run gapless from 0 in each shard, in the order
    of a key hash bucket, doc_id, crc and size. Equal rows are counted before
    the shuffle and dealt out again after it, so a hot row costs one row.
    """
    if list(grown[: len(weights)]) != list(weights):
        raise ValueError("grown must extend weights")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = rows.withColumn("own", _best(_bids(key, weights)))
    more = _bids(key, grown[len(weights) :], len(weights)) if len(grown) > len(weights) else []
    check = F.md5(F.concat_ws(":", key, F.col("text_crc32").cast("string")).cast("binary"))
    placed = own.select(
        "doc_id", "size", "text_crc32", "n", (-F.col("own.shard")).cast("int").alias("shard"), (-_best([F.col("own"), *more])["shard"]).cast("int").alias("grown_shard"),
        F.conv(F.substring(check, 1, BUCKET_DIGITS), 16, 10).cast("int").alias("bucket"),
    )
    placed = materialize(placed, "placed")
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    totals = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    # At most shards x 16 ** BUCKET_DIGITS rows: a proven bound for the broadcast.
    numbered = local.join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("start", F.col("offset") + F.col("before"))
    runs = numbered.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint"))))
    slots = runs.withColumn("k", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN - 1, F.col("n") - 1))))
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("k")).alias("slot"), "grown_shard")


def op5_rendezvous(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The registered query's columns: equal weights, one more shard in ``grown_shard``."""
    out = shard_rows(docs, [1.0] * shards, [1.0] * (shards + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle(shards: int = 16, table: str = "documents") -> str:
    """DuckDB SQL for ``op5_rendezvous`` over ``table``."""

    def pick(n: int) -> str:
        score = "-1.0::DOUBLE / ln((('0x' || substr(md5(k || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
        return f"list_max(list_transform(range({n}), lambda i: struct_pack(score := {score}, shard := -i)))"

    return f"""
    WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (
             SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END, i::BIGINT) AS c
             FROM range(256) r(i))),
         r AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
                      xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                                      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
               FROM {table}, tab),
         p AS (SELECT *, (-({pick(shards)}).shard)::INTEGER AS shard, (-({pick(shards + 1)}).shard)::INTEGER AS grown_shard,
                      ('0x' || substr(md5(k || ':' || text_crc32), 1, {BUCKET_DIGITS}))::INTEGER AS bucket FROM r)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
    FROM p"""
