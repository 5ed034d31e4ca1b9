"""The sink to several roots: one pass, all or nothing."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.sources import roots, sinks


def tree(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file())


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"text {i}", ("PLS", "NO_PLS", None, "a/b c")[i % 4]) for i in range(40)], "id int, text string, label string").repartition(3)


def test_all_roots_hold_all_rows(spark, rows, tmp_path):
    targets = [str(tmp_path / "a"), f"file://{tmp_path}/b/c"]
    for _ in range(2):  # the second run replaces the first
        sinks.write_by_label(rows, targets)
    for target in targets:
        back = spark.read.parquet(target)
        assert sorted(tuple(r) for r in back.select("id", "text", "label").collect()) == sorted(tuple(r) for r in rows.collect())
        assert {(r.label, r["__label"]) for r in back.collect()} == {("PLS", "PLS"), ("NO_PLS", "NO_PLS"), (None, None), ("a/b c", "a/b c")}
    assert not [p for p in tmp_path.rglob("_*") if p.is_dir() and not p.name.startswith("__label")]
    sinks.write_by_label(rows.limit(1), targets, mode="append")
    assert [spark.read.parquet(t).count() for t in targets] == [41, 41]


def test_the_plan_runs_once(spark, rows, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    sinks.write_by_label(rows.withColumn("text", counted("text")), [str(tmp_path / x) for x in "abc"])
    assert calls.value == 40


def test_a_failing_task_changes_no_root(spark, rows, tmp_path):
    targets = [str(tmp_path / "a"), str(tmp_path / "b")]
    sinks.write_by_label(rows, targets)
    before = [tree(t) for t in targets]

    @F.udf("string")
    def broken(i):
        if i == 17:
            raise RuntimeError("broken row")
        return str(i)

    with pytest.raises(Exception, match="broken row"):
        sinks.write_by_label(rows.withColumn("text", broken("id")), targets)
    assert [tree(t) for t in targets] == before


def test_a_failing_commit_puts_all_roots_back(spark, rows, tmp_path, monkeypatch):
    good, bad = tmp_path / "a", tmp_path / "b"
    sinks.write_by_label(rows, [str(good)])
    before = tree(good)
    writer = roots.RootsWriter([str(good), str(bad)], "label", True)
    message = writer.write(iter(rows.toArrow().to_batches()))
    os.remove(next(bad.rglob("part-*")))  # so that the second root can't be filled
    with pytest.raises(FileNotFoundError):
        writer.commit([message, None])
    assert tree(good) == before and tree(bad) == []


def test_left_overs_of_repeated_tasks_are_left_out(spark, rows, tmp_path):
    writer = roots.RootsWriter([str(tmp_path / "a")], "label", True)
    batches = rows.toArrow().to_batches()
    writer.write(iter(batches))  # a task whose result was lost
    writer.commit([writer.write(iter(batches))])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 40


def test_empty_table(spark, rows, tmp_path):
    sinks.write_by_label(rows, [str(tmp_path / "a")])
    sinks.write_by_label(rows.limit(0), [str(tmp_path / "a")])
    assert tree(tmp_path / "a") == []
    sinks.write_by_label(rows, [])
