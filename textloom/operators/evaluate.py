"""Classifier and system evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.let import ratio


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) of the pairs that occur."""
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) for each class, ``accuracy``, ``macro avg`` and ``weighted avg``."""
    cells = confusion(df, truth, predicted).select(F.col("truth").cast("string"), F.col("predicted").cast("string"), "n")
    sides = cells.select(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"), F.when(F.expr("truth = predicted"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.union(cells.select(F.col("predicted"), F.lit(0).cast("bigint"), F.col("n"), F.lit(0).cast("bigint")))
    by = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "said", "hit")))
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    per = by.select("class", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0).alias("f1"), "support", "hit")
    means = lambda f: [f(c).alias(c) for c in ("precision", "recall", "f1")]
    total = F.sum("support").alias("support")
    accuracy = ratio(F.sum("hit"), F.sum("support"))
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    rows = [
        per.drop("hit"),
        per.agg(accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), total).select(F.lit("accuracy").alias("class"), "*"),
        per.agg(*means(F.avg), total).select(F.lit("macro avg").alias("class"), "*"),
        per.agg(*means(weighted), total).select(F.lit("weighted avg").alias("class"), "*"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def log_loss(df: DataFrame, probability_of_truth: str) -> DataFrame:
    return df.agg(F.avg(-F.log(F.greatest(F.col(probability_of_truth), F.lit(1e-15)))).alias("log_loss"))


def system_means(df: DataFrame, system: str, metrics: Sequence[str], valid: str | None = None) -> DataFrame:
    """Means over valid rows by system, with n_samples and errors."""
    ok = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)
    return df.groupBy(system).agg(*(F.avg(F.when(ok, F.col(m))).alias(m) for m in metrics), F.count_if(ok).alias("n_samples"), F.count_if(~ok).alias("errors"))


def pivot_delta(means: DataFrame, system: str, metrics: Sequence[str], systems: Sequence[str], base: str) -> DataFrame:
    """A row per metric, a column per system, and ``delta_<system>`` against the base."""
    rows = means.unpivot(system, list(metrics), "metric", "value")
    wide = rows.groupBy("metric").pivot(system, list(systems)).agg(F.first("value"))
    return wide.select("metric", *systems, *((F.col(s) - F.col(base)).alias(f"delta_{s}") for s in systems if s != base))


def best_system(means: DataFrame, system: str, metrics: Sequence[str]) -> DataFrame:
    """(metric, best, value): the system with the highest mean, the least name if tied; nulls are passed over."""
    rows = means.unpivot(system, list(metrics), "metric", "value").where("value is not null")
    first = Window.partitionBy("metric").orderBy(F.desc("value"), system)
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("metric", F.col(system).alias("best"), "value")


def mean_action(df: DataFrame, column: str, low: float = 0.1, high: float = 1.0) -> DataFrame:
    return df.agg(F.greatest(F.lit(low), F.least(F.lit(high), F.avg(column))).alias("action"))
