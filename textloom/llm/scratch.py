"""Shared scratch space: tables written to cut lineage, readable by every executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import delete, shared_dir


def _own_dir(spark: SparkSession) -> str:
    """The application's folder below the shared one."""
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's scratch folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    The result no longer depends on the plan that made it, so a lost executor
    costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = 500_000, size: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``rows`` rows, and its files ``size`` bytes, else as it is."""
    if df.count() > rows:
        return df
    if df.inputFiles() and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > size:
        return df
    return F.broadcast(df)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables that this session made in the shared folder."""
    delete(spark, _own_dir(spark))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the Arrow batch length, so a batch of long texts fits in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
