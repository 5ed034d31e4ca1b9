"""Reports of jobs and streams."""

import time

import pytest
from pyspark.sql import functions as F

from textloom import streaming
from textloom.operators import telemetry
from textloom.plans import jobs


def test_a_jobs_rows_and_rate(spark, tmp_path):
    told = []

    @F.udf("bigint")
    def slow(x):
        time.sleep(0.02)
        return x

    out = str(tmp_path / "out")
    with telemetry.Watch(spark, "slow", every=0.1, rows=telemetry.rows_of(spark, out), report=told.append) as watch:
        spark.range(120, numPartitions=24).select(slow("id").alias("id")).write.parquet(out)
    last = watch.progress
    assert told == watch.reports and last.done and last.rows == 120 and last.remaining == 0
    assert last.rate == pytest.approx(120 / last.seconds)
    running = [p for p in told if not p.done and p.share]
    assert running and [p.share for p in running] == sorted(p.share for p in running)
    for p in running:
        assert p.remaining == pytest.approx(p.seconds * (1 - p.share) / p.share)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert "120 rows" in str(last) and "done" in str(last)


def test_a_failing_job_has_no_last_report(spark):
    with pytest.raises(Exception, match="zero"), telemetry.Watch(spark, "bad", report=lambda p: None) as watch:
        spark.range(3).select(F.expr("1 div (id - id)")).collect()
    assert not watch.reports or not watch.progress.done


def test_the_command_line_reports(spark, small, tmp_path, capsys):
    jobs.main(["metrics", "--input", f"{small}/documents.parquet", "--output-dir", str(tmp_path)])
    out = capsys.readouterr().out
    assert "[documents.parquet] 200 rows" in out and "rows/s" in out and "done" in out


def test_batches_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    watch = telemetry.StreamWatch("cleaned", total=30, report=lambda p: None)
    spark.streams.addListener(watch)
    try:
        source = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = streaming.clean_stream(source, min_words=1).writeStream.queryName("cleaned").option("checkpointLocation", str(tmp_path / "c")).format("parquet").trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        deadline = time.time() + 20
        while (not watch.reports or watch.reports[-1].rows < 30) and time.time() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    batches = [p for p in watch.reports if p.rows]
    assert [p.rows for p in batches][:3] == [10, 20, 30] and [p.batch for p in batches][:3] == [0, 1, 2]
    assert batches[0].share == pytest.approx(1 / 3) and batches[0].remaining > 0 and batches[2].remaining == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_duplicates_within_the_watermark(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "text string, at string").select("text", F.to_timestamp("at").alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.dedup_stream(streaming.read_documents(spark, str(tmp_path / "in"), "text string, at timestamp"), ["text"], "at")
    stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
