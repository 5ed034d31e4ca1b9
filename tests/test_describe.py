"""Correlations by co-moments, and descriptions whose summaries are broadcast."""

import random
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import session
from textloom.functions import metrics
from textloom.operators import comoments, describe


def pairwise(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    return np.corrcoef(a, b)[0, 1] if len(a) > 1 and a.std() > 0 and b.std() > 0 else None


@pytest.mark.parametrize(("parts", "batch"), [(1, 10_000), (7, 5), (50, 10_000)])
def test_correlations_equal_numpy(spark, parts, batch):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 6))
    x[:, 1] = 1e9 + x[:, 0] * 2 + x[:, 1]  # a large mean
    x[:, 4] = 3.0  # constant
    x[rng.random((300, 6)) < 0.2] = np.nan
    x[:, 5] = np.nan
    x[0, 5] = 1.0  # one value
    names = [f"m{i}" for i in range(6)]
    rows = [tuple(None if np.isnan(v) and (i + r) % 2 else float(v) for i, v in enumerate(row)) for r, row in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    got = {(r.a, r.b): r.corr for r in describe.correlations(df, names).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == 36
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            want = pairwise(x, i, j)
            assert got[a, b] is None if want is None else got[a, b] == pytest.approx(want, abs=1e-6)


def test_merging_equals_one_block():
    rng = np.random.default_rng(4)
    x = rng.normal(5, 2, (90, 4))
    x[rng.random((90, 4)) < 0.3] = np.nan
    whole = comoments.Block.of(x)
    parts = comoments.Block.of(x[:0])
    for at in (x[:1], x[1:40], x[40:]):
        parts = parts.merged(comoments.Block.of(at))
    for field in comoments.FIELDS:
        assert getattr(parts, field) == pytest.approx(getattr(whole, field))


def test_all_of_family_b_in_one_pass(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    df = session.written(metrics.with_metrics(docs, "text"), "family-b")
    found = describe.correlations(df, df.columns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = {(r.a, r.b): r.corr for r in found.collect()}
    assert len(got) == len(df.columns) ** 2
    x = np.array([[np.nan if v is None else float(v) for v in r] for r in df.collect()])
    for i, a in enumerate(df.columns):
        for j, b in enumerate(df.columns):
            want = pairwise(x, i, j)
            assert got[a, b] is None if want is None else got[a, b] == got[b, a] == pytest.approx(want, abs=1e-9)


def test_empty_table_has_no_correlation(spark):
    df = spark.createDataFrame([], "a double, b double, c double")
    got = describe.correlations(df, ["a", "b", "c"]).collect()
    assert len(got) == 9 and all(r.corr is None for r in got)
    with pytest.raises(ValueError, match="three"):
        describe.correlations(df, ["a", "b"])


@pytest.mark.parametrize("of", [describe.box_statistics, describe.histogram])
def test_values_are_not_shuffled_by_label(spark, small, of):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("lang", "doc_id", "n_chars")
    plan = of(docs, "lang", ["doc_id", "n_chars"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_release_deletes_the_librarys_tables(spark):
    table = session.written(spark.range(3), "kept")
    file = Path(urlsplit(table.inputFiles()[0]).path)
    assert table.count() == 3 and file.exists()
    session.release(spark)
    assert not file.exists() and not Path(urlsplit(session.shared_folder(spark)).path).exists()
    session.release(spark)


def test_variances_that_are_equal_once_rounded_go_by_name(spark):
    rows = [("x", 1.0, 1.00001, 5.0), ("y", 2.0, 2.00003, 9.0)]
    df = spark.createDataFrame(rows, "label string, b double, c double, d double")
    top = describe.top_variance(df, "label", ("c", "b", "d"), 2, digits=3)
    assert [tuple(r) for r in top.select("metric", "variance").collect()] == [("d", 8.0), ("b", 0.5)]


def test_percentiles_of_a_sketch_that_differs_each_time(spark, monkeypatch):
    sketch = F.percentile_approx
    wider = F.udf(lambda b: [x + random.randrange(400) * (1 if i % 2 else -1) for i, x in enumerate(b)], "array<double>")
    monkeypatch.setattr(describe.F, "percentile_approx", lambda *a: wider(sketch(*a)))
    values = spark.range(20_001, numPartitions=8).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("value"))
    want = {r.k: r.q for r in values.groupBy("k").agg(F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).collect()}
    assert {r.k: r.q for r in describe.percentiles(values, ["k"], [0.25, 0.5, 0.75]).collect()} == want
