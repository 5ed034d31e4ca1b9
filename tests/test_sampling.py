"""Cuts in a seeded order: exact sizes, narrow plans, equal keys and equal rows."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators import sampling
from textloom.plans import corpus


def firsts(rows, wanted, seed=42):
    """The keys of each group's first rows, in the order of md5(seed:key)."""
    groups = defaultdict(list)
    for group, key in rows:
        groups[group].append((hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest(), key))
    return {g: [k for _, k in sorted(v, key=lambda x: x[0])[: wanted(len(v))]] for g, v in groups.items()}


@pytest.mark.parametrize(("digits", "small"), [(3, 10_000), (1, 4), (2, 1)])
def test_cap_takes_the_first_rows(spark, monkeypatch, digits, small):
    monkeypatch.setattr(sampling, "DIGITS", digits)
    monkeypatch.setattr(sampling, "SMALL", small)
    rows = [("hot", i) for i in range(700)] + [("cold", i) for i in range(700, 705)] + [("one", 9000)]
    df = spark.createDataFrame(rows, "g string, id bigint")
    got = defaultdict(set)
    for r in sampling.cap_groups(df, ["g"], 50, "id").collect():
        got[r.g].add(r.id)
    assert got == {g: set(v) for g, v in firsts(rows, lambda n: min(n, 50)).items()}


def test_rows_of_equal_key_are_told_apart(spark):
    rows = [("a", 1, f"text {i % 4}") for i in range(40)] + [("a", 2, "other")] * 3 + [("b", None, "x")] * 5
    df = spark.createDataFrame(rows, "g string, id bigint, text string")
    for limit in (1, 7, 39, 42):
        got = sampling.cap_groups(df, ["g"], limit, "id").collect()
        assert Counter(r.g for r in got) == {"a": min(43, limit), "b": min(5, limit)}
        assert not Counter(tuple(r) for r in got) - Counter(rows)
        again = sampling.cap_groups(df.repartition(7), ["g"], limit, "id").collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    split = sampling.stratified_split(df, ["g"], "id").collect()
    assert Counter((r.g, r.split) for r in split) == {("a", "test"): 8, ("a", "train"): 35, ("b", "test"): 1, ("b", "train"): 4}
    three = sampling.three_way_split(df, "id").collect()
    assert Counter(r.split for r in three) == {"train": 33, "validation": 7, "test": 8}


def test_splitting_documents_shuffles_no_text(spark):
    """The narrow tables are written before; what is left scans the documents once and joins broadcast cuts."""
    docs = spark.range(500).select(
        F.col("id").alias("s3_key"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "pls").otherwise("no_pls").alias("label"), (F.col("id") % 7).cast("string").alias("source")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = corpus.split_documents(docs, corpus.Settings(group_cap=20), "s3_key")
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        got = Counter((r.label, r.source, r.split) for r in split.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(got.values()) == {4, 16}


def test_empty_table_and_no_groups(spark):
    df = spark.createDataFrame([], "g string, id bigint")
    assert sampling.cap_groups(df, ["g"], 5, "id").count() == 0 and sampling.three_way_split(df, "id").count() == 0
    assert sampling.cap_groups(spark.createDataFrame([(None, 1)], "g string, id bigint"), ["g"], 5, "id").count() == 0


def test_first_per_label_and_dedup_counts(spark):
    parts = {"PLS": spark.createDataFrame([("a",), (" ",), (None,), ("b",), ("c",)], "body string").coalesce(1), "NO_PLS": spark.createDataFrame([("d",)], "body string")}
    got = sampling.first_per_label(parts, "body", 4).collect()
    assert sorted(tuple(r) for r in got) == [("a", "PLS"), ("b", "PLS"), ("d", "NO_PLS")]
    docs = spark.createDataFrame([(1, "x", "pls"), (2, "x", "pls"), (3, "x", "no_pls"), (4, "y", "pls")], "s3_key int, text string, label string")
    counts = corpus.dedup_counts(docs, corpus.deduplicate(docs))
    assert sorted(tuple(r) for r in counts.collect()) == [("no_pls", 1, 1, 0), ("pls", 3, 2, 1)]
