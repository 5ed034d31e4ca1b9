"""Session settings that the library's plans are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(name: str = "textloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS, overridden by ``settings`` (dots written as ``__``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``, with its scheme, so that Python on the executors resolves it as Spark does.

    Where that is unset a local master gets a temporary folder; elsewhere that is
    an error, as executors would not share it.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
        path = sc.getCheckpointDir()
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(jpath).toString().rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """The application's folder for the library's own files below the shared one."""
    return f"{shared_dir(spark)}/textloom-files/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store that Spark reads; one that isn't there is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what the library has written for this application in the shared folder; tables that were read from it are lost."""
    delete(spark, shared_folder(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back, so that it is computed once and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession | None = None, rows: int = 1000, size: int = 1 << 20) -> None:
    """Lower the length and the bytes of Arrow batches, so that what a Python worker holds at once doesn't grow with a partition or with long texts."""
    spark = spark or SparkSession.getActiveSession()
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most, parse in (("maxRecordsPerBatch", rows, int), ("maxBytesPerBatch", size, in_bytes)):
        name = f"spark.sql.execution.arrow.{key}"
        held = parse(spark.conf.get(name))
        if held <= 0 or held > most:
            spark.conf.set(name, str(most))


def checked_broadcast(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` (of written rows, each of bounded size) with a broadcast hint if it is counted to hold at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df
