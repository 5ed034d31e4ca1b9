"""Descriptive statistics by label, as plot-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import comoments
from textloom.session import checked_broadcast, written

#: Accuracy of the sketches that bracket percentiles, and groups whose brackets are broadcast.
ACCURACY, GROUPS = 10_000, 100_000


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def label_share(df: DataFrame, label: str) -> DataFrame:
    """Rows by label and their percentage, to one decimal."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 1))


def summary_cards(df: DataFrame, label: str, means: Sequence[str]) -> DataFrame:
    """One row: rows, distinct labels and the means of some columns."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(label).alias("n_labels"), *(F.avg(c).alias(f"mean_{c}") for c in means))


def long_form(df: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """(label, metric, value): one row per non-null value."""
    cast = df.select(label, *(F.col(c).cast("double").alias(c) for c in metrics))
    return cast.unpivot(label, list(metrics), "metric", "value").where("value is not null")


def percentiles(values: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(keys, n, q): exact percentiles of ``value`` by ``keys`` (nulls are a key), linearly between neighbours.

    No group is held or sorted as a whole: a mergeable sketch brackets each
    percentile, rows below the bracket are counted, and only the values inside
    it, some ten-thousandths of the group, are ranked.
    """
    held = written(values.select(*keys, F.to_json(F.struct(*keys)).alias("__key"), F.col("value").cast("double").alias("value")), "values")
    margin = 2.0 / ACCURACY
    ends = F.array(*(F.lit(float(min(1.0, max(0.0, p + d)))) for p in shares for d in (-margin, margin)))
    groups = held.groupBy("__key").agg(*(F.first(k).alias(k) for k in keys), F.count("*").alias("n"), F.percentile_approx("value", ends, F.lit(ACCURACY)).alias("b"))
    # A sketch depends on the order in which its parts arrive: computed again, it gives other brackets, and counts of one don't fit values of another.
    groups = written(groups, "brackets")
    place = lambda p: (F.col("n") - 1) * p
    targets = F.array(*(F.struct(F.lit(i).alias("i"), F.col("b")[2 * i].alias("lo"), F.col("b")[2 * i + 1].alias("hi"), place(p).alias("at")) for i, p in enumerate(shares)))
    wanted = groups.select("__key", F.explode(targets).alias("t")).select("__key", "t.*")
    if groups.count() <= GROUPS:
        wanted = F.broadcast(wanted)
    met, value, one = held.select("__key", "value").join(wanted, "__key"), F.col("value"), ["__key", "i"]
    outside = met.groupBy(*one).agg(
        F.first("at").alias("at"), F.count(F.when(value < F.col("lo"), 1)).alias("below"),
        F.max(F.when(value < F.col("lo"), value)).alias("under"), F.min(F.when(value > F.col("hi"), value)).alias("over"),
    )
    inside = met.where(value.between(F.col("lo"), F.col("hi"))).groupBy(*one, "value").agg(F.count("*").alias("c"))
    ranked = inside.withColumn("end", F.sum("c").over(Window.partitionBy(*one).orderBy("value"))).join(outside, one)
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda rank: F.max(F.when((F.col("below") + F.col("end") - F.col("c") <= rank) & (rank < F.col("below") + F.col("end")), value))
    found = ranked.groupBy(*one).agg(*(F.first(c).alias(c) for c in ("at", "below", "under", "over")), F.max("end").alias("held"), holds(low).alias("a"), holds(high).alias("z"))
    # A neighbour's rank may lie one beyond the bracket.
    beyond = lambda rank: F.when(rank == F.col("below") - 1, F.col("under")).when(rank == F.col("below") + F.col("held"), F.col("over")).otherwise(F.raise_error(F.lit("a sketch missed a percentile")))
    a, z = (F.coalesce(F.col(c), beyond(rank)) for c, rank in (("a", low), ("z", high)))
    between = F.when(a == z, a).otherwise((high - F.col("at")) * a + (F.col("at") - low) * z)
    q = found.select("__key", F.struct("i", between.alias("v")).alias("x")).groupBy("__key").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]).alias("q"))
    return groups.drop("b").join(q, "__key").select(*keys, "n", "q")


def medians(df: DataFrame, label: str, metrics: Sequence[str], unlabelled: bool = False) -> DataFrame:
    """(metric, label, median) of every metric; with ``unlabelled``, rows without a label are a group, too."""
    values = long_form(df if unlabelled else df.where(F.col(label).isNotNull()), label, metrics)
    return percentiles(values, ["metric", label], [0.5]).select("metric", label, F.col("q")[0].alias("median"))


def top_variance(df: DataFrame, label: str, metrics: Sequence[str], limit: int = 12, digits: int | None = None, unlabelled: bool = False) -> DataFrame:
    """The metrics whose medians vary most over labels (sample variance); with ``digits``, variances are rounded first, and equal ones go by name."""
    spread = medians(df, label, metrics, unlabelled).groupBy("metric").agg(F.var_samp("median").alias("variance")).where("variance is not null")
    if digits is not None:
        spread = spread.withColumn("variance", F.round("variance", digits))
    return spread.orderBy(F.desc("variance"), "metric").limit(limit)


def box_statistics(df: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers by metric and label; a whisker is the furthest value within 1.5 times the quartile range."""
    values = written(long_form(df, label, metrics), "box-values")
    quart = percentiles(values, ["metric", label], [0.25, 0.5, 0.75])
    quart = quart.select("metric", label, "n", *(F.col("q")[i].alias(k) for i, k in enumerate(("q1", "median", "q3"))))
    quart = checked_broadcast(written(quart, "quartiles"), GROUPS)
    margin = 1.5 * (F.col("q3") - F.col("q1"))
    joined = values.join(quart, (values["metric"] == quart["metric"]) & values[label].eqNullSafe(quart[label])).select(quart["*"], "value")
    inside = F.when(F.col("value").between(F.col("q1") - margin, F.col("q3") + margin), F.col("value"))
    return joined.groupBy("metric", label, "n", "q1", "median", "q3").agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))


def histogram(df: DataFrame, label: str, metrics: Sequence[str], bins: int = 50) -> DataFrame:
    """(metric, label, bin, low, high, density): equal-width bins over each subset's own range, the last closed.

    A subset of one value gets the range of half a unit on either side.
    """
    values = long_form(df, label, metrics)
    span = values.groupBy("metric", label).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    point = F.col("lo") == F.col("hi")
    span = span.withColumn("low0", F.when(point, F.col("lo") - 0.5).otherwise(F.col("lo"))).withColumn("w", F.when(point, F.lit(1.0 / bins)).otherwise((F.col("hi") - F.col("lo")) / bins))
    span = checked_broadcast(written(span, "spans"), GROUPS)
    joined = values.join(span, (values["metric"] == span["metric"]) & values[label].eqNullSafe(span[label])).select(span["*"], "value")
    slot = F.least(F.floor((F.col("value") - F.col("low0")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counted = joined.groupBy("metric", label, slot.alias("bin")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("low0").alias("low0"), F.first("w").alias("w"))
    low = F.col("low0") + F.col("bin") * F.col("w")
    return counted.select("metric", label, "bin", low.alias("low"), (low + F.col("w")).alias("high"), (F.col("c") / (F.col("n") * F.col("w"))).alias("density"))


def correlations(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(a, b, corr): the correlation matrix of three columns or more (see ``comoments``)."""
    if len(metrics) < 3:
        raise ValueError("a correlation matrix takes three columns or more")
    return comoments.correlations(df, metrics)


def drop_null_metric(df: DataFrame, metric: str) -> DataFrame:
    return df.dropna(subset=[metric])
