"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns; it is known by its depth and the
exclusive-or of its turns' digests, each taken together with the turn's place
(120 bits: 10^11 nodes collide with a probability of 10^-14), so ids of prefixes are
running totals. The least member of a node owns it. A conversation owns a suffix
of its own path, as all members of a node below an owned one are members of the
owned one. So a node's subtree needs no walk: windows mark the owned nodes of
every path, and each occurrence knows, from a running sum up its own path, the
bytes that its conversation passes without owning them, and whether it owns the
leaf at its end. One grouping by node adds these up: every node below is owned
once, and the rest are the tokens saved.

No group is held in one task: prefixes of common turns are few and have their
owners broadcast, paths are summed in pieces of ``PIECE`` turns.

Defined results: turns are ordered by turn (nulls first), then by a digest of
role and text; a null role or text is the empty string; repeated rows are turns
of their own; rows of a null conv_id take no part; texts count whole, however
long; a conversation that rebuilding leaves without turns is a member of the
root alone; an empty table has no nodes, not even a root. Columns other than
conv_id, turn, role and text aren't read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.checksums import CRC_TABLE, crc32
from textloom.llm.runs import joined_sha256, placed
from textloom.llm.scratch import checked_broadcast, materialize

#: Turns of a path that are summed together.
PIECE = 4096
#: A node with more than this share of all occurrences has its owner broadcast; there are no more than 1 / share of them.
HOT_SHARE = 1e-4
#: Members that no node is hot below; fewer than 1 / share nodes are above it where the share of all occurrences is less.
HOT_LEAST = 100
#: Contract of the registered query: a conversation's donor is the one at the multiple of FAMILY at or before it, and gives HEADS - 1 turns at most.
FAMILY = 5
HEADS = 9
NODE = ("depth", "x", "y")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes): a narrow row a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text).cast("binary")).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, length, digest, bytes) of the rebuilt conversations; a row of depth 0 for each, and turns from depth 1.

    ``rows`` are those of ``turns``. A conversation takes its donor's first
    turns (HEADS - 1 at most, so a donor's turns are held in one row), then its
    own after as many.
    """
    at = placed(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], "turns")
    at = materialize(at.select("conv_id", (F.col("before") + 1).alias("pos"), "digest", "bytes"), "placed")
    heads = (
        at.where((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    )
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = at.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", wanted)
    convs = convs.join(heads, F.col("base") == F.col("conv_id") - F.col("conv_id") % FAMILY, "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:string,bytes:bigint>>")), 1, F.col("h").cast("int")))
    convs = convs.withColumn("taken", F.size("head").cast("bigint"))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "families")
    root = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("bytes"))
    given = convs.select("conv_id", "length", F.explode(F.concat(F.array(root), "head")).alias("t")).select("conv_id", "t.pos", "length", "t.digest", "t.bytes")
    kept = at.where(F.col("pos") > wanted).join(convs.select("conv_id", "length", (F.col("taken") - F.col("h")).alias("shift")), "conv_id")
    own = kept.select("conv_id", F.col("pos") + F.col("shift"), "length", "digest", "bytes")
    return given.union(own).withColumnRenamed("pos", "depth")


def _lane(k: int) -> Column:
    """60 bits of the digest of a turn at its place; the root has none."""
    placed_turn = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")).cast("binary"))
    return F.when(F.col("depth") > 0, F.conv(F.substring(placed_turn, 1 + 15 * k, 15), 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def prefixes(paths: DataFrame) -> DataFrame:
    """``paths`` with the node (x, y beside depth) that each turn completes, and its piece."""
    rows = paths.withColumn("piece", F.expr(f"depth div {PIECE}")).withColumn("a", _lane(0)).withColumn("b", _lane(1)).drop("digest")
    rows = materialize(rows, "lanes")
    w = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("x", F.bit_xor("a").over(w)).withColumn("y", F.bit_xor("b").over(w)).drop("a", "b")
    totals = rows.where(F.col("length") >= PIECE).groupBy("conv_id", "piece").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "piece", F.bit_xor("a").over(earlier).alias("ax"), F.bit_xor("b").over(earlier).alias("by")).where("piece > 0")
    both = local.join(checked_broadcast(materialize(offsets, "offsets")), ["conv_id", "piece"], "left")
    shifted = [F.col(k).bitwiseXOR(F.coalesce(F.col(o), F.lit(0).cast("bigint"))).alias(k) for k, o in (("x", "ax"), ("y", "by"))]
    return both.select("conv_id", "depth", "length", "bytes", "piece", *shifted)


def owned(occurrences: DataFrame) -> DataFrame:
    """``occurrences`` (of written rows) with the node's owner and its longest member's length as ``deepest``.

    A hot node's rows are told what a grouping with map-side sums has found;
    the others' windows hold HOT_SHARE of all rows at most.
    """
    least = max(HOT_LEAST, int(occurrences.count() * HOT_SHARE))
    summary = occurrences.groupBy(*NODE).agg(F.count("*").alias("members"), F.min("conv_id").alias("hot_owner"), F.max("length").alias("hot_deepest"))
    # 1 / HOT_SHARE rows at most.
    hot = F.broadcast(summary.where(F.col("members") > least).drop("members"))
    told = occurrences.join(hot, [*NODE], "left")
    # Rows of hot nodes need no window; each is dealt out by its own conversation.
    w = Window.partitionBy(*NODE, F.when(F.col("hot_owner").isNotNull(), F.col("conv_id")))
    return told.withColumns(
        {"owner": F.coalesce("hot_owner", F.min("conv_id").over(w)), "deepest": F.coalesce("hot_deepest", F.max("length").over(w))}
    ).drop("hot_owner", "hot_deepest")


def _climbed(marked: DataFrame) -> DataFrame:
    """``marked`` (written) with, of each occurrence's own path: what lies below it, and its parent's owner."""
    up = Window.partitionBy("conv_id", "piece").orderBy(F.col("depth").desc())
    below = up.rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("owner") == F.col("conv_id")
    rows = marked.withColumns(
        {
            "mine": mine.cast("bigint"),
            "passed": F.when(mine, 0).otherwise(F.col("bytes")).cast("bigint"),
            "leaf": (mine & (F.col("depth") == F.col("length")) & (F.col("deepest") == F.col("depth"))).cast("bigint"),
        }
    )
    # Of paths of several pieces: what the pieces after hold, and what lies next to a piece's ends.
    long = rows.where(F.col("length") >= PIECE).groupBy("conv_id", "piece").agg(
        F.sum("passed").alias("passed"), F.max("leaf").alias("leaf"), F.min_by("mine", "depth").alias("first_mine"), F.max_by("owner", "depth").alias("last_owner"),
    )
    order = Window.partitionBy("conv_id").orderBy("piece")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    ends = long.select(
        "conv_id", "piece", F.sum("passed").over(after).alias("after_passed"), F.max("leaf").over(after).alias("after_leaf"),
        F.lead("first_mine").over(order).alias("after_mine"), F.lag("last_owner").over(order).alias("before_owner"),
    )
    joined = rows.withColumns(
        {
            "rest": F.sum("passed").over(below),
            "leaves": F.max("leaf").over(below),
            "child": F.lag("mine").over(up),
            "parent": F.lead("owner").over(up),
        }
    ).join(checked_broadcast(materialize(ends, "ends")), ["conv_id", "piece"], "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *NODE, "conv_id", "length", "owner",
        (F.col("rest") + F.coalesce("after_passed", zero)).alias("rest"),
        F.greatest("leaves", F.coalesce("after_leaf", zero)).alias("leaves"),
        F.coalesce("child", "after_mine", zero).alias("child"),
        F.coalesce("parent", "before_owner").alias("parent"),
    )


def trie(paths: DataFrame) -> DataFrame:
    """A row per node of the conversations in ``paths`` (the rows of ``rebuilt``), its id hashes included."""
    marked = materialize(owned(materialize(prefixes(paths), "prefixes")), "marked")
    nodes = _climbed(marked).groupBy(*NODE).agg(
        F.min("owner").alias("conv_id"), F.min("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("rest").alias("saved_tokens"),
    )
    ends = marked.where("depth = length").select(*NODE, "conv_id", F.col("conv_id").cast("string").alias("item"))
    return nodes.join(joined_sha256(ends, NODE, "conv_id", "item", ",", "ends_sha256"), [*NODE], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    )


def op12_trie(conversations: DataFrame) -> DataFrame:
    """The registered query's columns, over the conversations rebuilt by their donors."""
    return trie(rebuilt(turns(conversations))).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL for ``op12_trie`` over ``table``: nodes are lists of turns, and every node adds to all its prefixes."""
    return f"""
    WITH {CRC_TABLE},
         r AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS t,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS pos
               FROM {table} WHERE conv_id IS NOT NULL),
         g AS (SELECT conv_id, list(t ORDER BY pos) AS own FROM r GROUP BY conv_id),
         c AS (SELECT g.*, {crc32("conv_id::VARCHAR")} % {HEADS} AS h FROM g, crc),
         p AS (SELECT c.conv_id, list_concat(coalesce(d.own[1:c.h], []), c.own[c.h + 1:]) AS path
               FROM c LEFT JOIN c d ON d.conv_id = c.conv_id - c.conv_id % {FAMILY}),
         o AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path FROM p),
         n AS (SELECT depth, path[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs,
                      coalesce(octet_length(encode(any_value(path[depth].t))), 0) AS bytes, max(len(path)) = depth AS leaf,
                      coalesce(string_agg(CASE WHEN len(path) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
               FROM o GROUP BY 1, 2),
         up AS (SELECT unnest(range(depth + 1)) AS above, * FROM n),
         s AS (SELECT node[1:above] AS node, above AS depth, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves,
                      count(*) FILTER (depth = above + 1) AS n_children
               FROM up GROUP BY 1, 2)
    SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
    FROM n JOIN s ON s.depth = n.depth AND s.node = n.node LEFT JOIN n q ON q.depth = n.depth - 1 AND q.node = n.node[1:n.depth - 1]"""
