"""Pairs of technical and plain texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest(df: DataFrame, group: str, text: str, when: Column, order: str) -> Column:
    """The longest text among the rows where ``when`` holds; of equally long ones the first by ``order``."""
    return F.min_by(F.when(when, F.col(text)), F.when(when, F.struct(-F.length(text), F.col(order))))


def pairs(df: DataFrame, group: str, text: str = "text", label: str = "label", order: str = "doc_id", technical: str = "no_pls", plain: str = "pls") -> DataFrame:
    """(pair_id, medical, plain) for each group with both sides: one aggregation instead of a join."""
    side = lambda name: longest(df, group, text, F.col(label) == name, order)
    found = df.where(F.col(group).isNotNull()).groupBy(group).agg(side(technical).alias("medical"), side(plain).alias("plain"))
    return found.where("medical is not null and plain is not null").select(F.col(group).cast("string").alias("pair_id"), "medical", "plain")


def section_pairs(files: DataFrame, name: str = "name") -> DataFrame:
    """(base_name, medical, plain): each base file with each of its sections, null if it has none.

    Sections without a base file are dropped.
    """
    mark = "_accumulated_section"
    section = F.contains(F.col(name), F.lit(mark))
    plain = files.where(section).select(F.substring_index(name, mark, 1).alias("base_name"), F.col(name).alias("plain"))
    base = files.where(~section).select(F.replace(F.col(name), F.lit(".txt"), F.lit("")).alias("base_name"), F.col(name).alias("medical"))
    base = base.groupBy("base_name").agg(F.max("medical").alias("medical"))
    return base.join(plain, "base_name", "left")
