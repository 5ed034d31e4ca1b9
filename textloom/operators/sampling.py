"""Deduplication, caps and splits in a seeded, reproducible order.

The order is that of md5(seed:key). Rows are picked by cuts: of every group, the
hash up to which its first rows go. A narrow table of (group, hash) is written
once; ranges of the hash are counted in it, and the range that a cut falls into
is divided until it holds ``SMALL`` rows, so no group is sorted as a whole. The
cuts are then broadcast (if their number allows it) and rows marked in one scan
that shuffles nothing.

Rows of equal key share a hash. If a cut falls between such rows, they alone are
told apart by a digest of all their columns, and equal rows by their number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import checked_broadcast, written

#: Hex digits of the hash by which a range is divided, and rows of a range that are ranked.
DIGITS, SMALL = 3, 10_000
HASH = 32


def seeded(key: str | Column, seed: int = 42) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))).cast("binary"))


def digest(keys: Sequence[str]) -> Column:
    """SHA-256 of the columns; nulls differ from every value."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("null")) for k in keys]
    return F.sha2(F.concat_ws(",", *parts).cast("binary"), 256)


def drop_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, of each group of equal ``keys``; nulls are equal.

    Rows are grouped by a digest of the keys, so a long key is sent once, in its
    row. ``min_by`` folds rows before the shuffle, so a group of many copies
    costs a row a task.
    """
    return df.groupBy(digest(keys).alias("__key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row")).select("__row.*")


def _group(keys: Sequence[str]) -> Column:
    return digest(keys) if keys else F.lit("")


def _holding(ranges: DataFrame, *carried: str) -> DataFrame:
    """Of (g, r, c, left) ranges, the one of each group that holds its left-th row, with ``left`` counted inside it."""
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("r"))
    inside = F.col("left") - F.col("upto") + F.col("c")
    found = ranges.withColumn("upto", upto).where((F.col("left") <= F.col("upto")) & (inside > 0))
    return found.select("g", *carried, "r", "c", inside.alias("left"))


def _cuts(narrow: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """(g, cut, left, ties) of written (g, h) rows: the first ``wanted(n)`` rows of a group of n are those below ``cut``, and ``left`` of the ``ties`` at it."""
    counts = narrow.groupBy("g", F.substring("h", 1, DIGITS).alias("r")).agg(F.count("*").alias("c"))
    counts = written(counts, "ranges")
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n")).withColumn("want", wanted(F.col("n")).cast("bigint"))
    # Nothing is below the empty string, and every hash is below a letter that isn't a hex digit.
    ends = sizes.where("want <= 0 or want >= n").select("g", F.when(F.col("want") <= 0, "").otherwise("z").alias("cut"), F.lit(0).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("ties"))
    open_ = written(_holding(counts.join(sizes.where("want > 0 and want < n").select("g", F.col("want").alias("left")), "g")), "open")
    found, digits = [], DIGITS
    while True:
        small = open_.where((F.col("c") <= SMALL) | (F.length("r") >= HASH))
        found.append(_ranked(narrow, small, digits))
        large = open_.where((F.col("c") > SMALL) & (F.length("r") < HASH))
        if large.isEmpty():
            break
        inside = _inside(narrow, large, digits)
        digits = min(digits + DIGITS, HASH)
        deeper = inside.groupBy("g", F.substring("h", 1, digits).alias("r"), "left").agg(F.count("*").alias("c"))
        open_ = written(_holding(deeper), "open")
    return written(reduce(DataFrame.union, found).union(ends), "cuts")


def _inside(narrow: DataFrame, ranges: DataFrame, digits: int) -> DataFrame:
    """(g, h, left) of the rows in written ranges, one a group."""
    some = checked_broadcast(ranges.select("g", F.col("r").alias("__r"), "left"))
    return narrow.join(some, (narrow["g"] == some["g"]) & (F.substring("h", 1, digits) == F.col("__r"))).select(narrow["g"], "h", "left")


def _ranked(narrow: DataFrame, ranges: DataFrame, digits: int) -> DataFrame:
    """Cuts of groups whose ranges are small: at most SMALL hashes a group are put in order."""
    hashes = _inside(narrow, ranges, digits).groupBy("g", F.col("h").alias("r"), "left").agg(F.count("*").alias("c"))
    return _holding(hashes).select("g", F.col("r").alias("cut"), "left", F.col("c").alias("ties"))


def _pick(df: DataFrame, keys: Sequence[str], key: str, seed: int, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with a column for each of ``wanted``: whether a row is among the first ``wanted(n)`` of its group of n, in seeded order."""
    group, place = _group(keys), seeded(key, seed)
    narrow = written(df.select(group.alias("g"), place.alias("h")), "order")
    rows, names = df.withColumns({"__g": group, "__h": place}), list(df.columns)
    for name, want in wanted.items():
        cuts = _cuts(narrow, want)
        torn = cuts.where("left > 0 and left < ties")
        cut = checked_broadcast(cuts.select(F.col("g").alias("__g"), F.struct("cut", "left", "ties").alias("__cut")))
        rows = rows.join(cut, "__g")
        at = F.col("__h") == F.col("__cut.cut")
        first = (F.col("__h") < F.col("__cut.cut")) | (at & (F.col("__cut.left") >= F.col("__cut.ties")))
        if torn.isEmpty():
            rows = rows.withColumn(name, first).drop("__cut")
        else:
            split = at & (F.col("__cut.left") < F.col("__cut.ties"))
            whole = rows.where(~split).withColumn(name, first).drop("__cut")
            rows = whole.unionByName(_told_apart(rows.where(split), names, name))
        names.append(name)
    return rows.drop("__g", "__h")


def _told_apart(rows: DataFrame, names: Sequence[str], mark: str) -> DataFrame:
    """Rows of one key a group, the first ``__cut.left`` of them marked, in the order of a digest of all columns."""
    kept = [c for c in rows.columns if c != "__cut"]
    kinds = rows.withColumn("__d", digest(names)).groupBy("__g", "__d").agg(F.first(F.struct(*kept)).alias("__row"), F.first("__cut.left").alias("left"), F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("__g").orderBy("__d")) - F.col("c")
    here = F.greatest(F.least(F.col("left") - F.col("before"), F.col("c")), F.lit(0))
    marked = kinds.withColumn("before", before).withColumn("here", here)
    copies = marked.select("__row", "here", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))).alias("i"))
    return copies.select("__row.*", (F.col("i") <= F.col("here")).alias(mark))


def cap_groups(df: DataFrame, keys: Sequence[str], limit: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``limit`` rows of each group, in seeded order; rows with a null group key go."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return _pick(df.where(known), keys, key, seed, {"__first": lambda n: F.least(n, F.lit(limit))}).where("__first").drop("__first")


def test_size(n: Column, fraction: float = 0.2) -> Column:
    """Rows of a group that go to the test side: floor, but 1 if that is 0, and one less than all at most."""
    size = F.floor(n * F.lit(fraction))
    size = F.when((size == 0) & (n > 1), F.lit(1)).otherwise(size)
    return F.greatest(F.when(size >= n, n - 1).otherwise(size), F.lit(0)).cast("bigint")


def stratified_split(df: DataFrame, keys: Sequence[str], key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: ``test`` for the first rows of each group in seeded order, else ``train``."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    picked = _pick(replace(df, "split").where(known), keys, key, seed, {"__first": lambda n: test_size(n, fraction)})
    return picked.withColumn("split", F.when(F.col("__first"), "test").otherwise("train")).drop("__first")


def replace(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name) if name in df.columns else df


def three_way_split(df: DataFrame, key: str, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: floor(train * n) rows, then floor(validation * n), then the rest, in seeded order."""
    floor = lambda n, share: F.floor(n * F.lit(share)).cast("bigint")
    wanted = {"__train": lambda n: floor(n, train), "__first": lambda n: floor(n, train) + floor(n, validation)}
    marked = _pick(replace(df, "split"), (), key, seed, wanted)
    name = F.when(F.col("__train"), "train").when(F.col("__first"), "validation").otherwise("test")
    return marked.withColumn("split", name).drop("__train", "__first")


def shuffled_sample(df: DataFrame, key: str, limit: int, seed: int = 42) -> DataFrame:
    """The first ``limit`` rows in seeded order."""
    return df.orderBy(seeded(key, seed), key).limit(limit)


def first_per_label(parts: dict[str, DataFrame], text_col: str, limit: int) -> DataFrame:
    """chunk_text and label of the first ``limit`` rows of each label's table, without blank texts."""
    frames = [df.select(F.col(text_col).alias("chunk_text"), F.lit(label).alias("label")).limit(limit) for label, df in parts.items()]
    return reduce(DataFrame.unionByName, frames).where(F.trim("chunk_text") != "")
