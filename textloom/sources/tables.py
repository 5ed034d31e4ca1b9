"""Tables: Parquet, CSV, cached results and configuration files."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Sequence
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession

from textloom.schemas import pick_column, require_columns


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def read_parquets(spark: SparkSession, folder: str, names: Sequence[str], columns: Sequence[str] = ("doc_id", "text", "label")) -> DataFrame:
    """The union of those tables that exist, each with the required columns; none at all is an error."""
    paths = [p for p in (f"{folder.rstrip('/')}/{n}" for n in names) if _exists(spark, p)]
    if not paths:
        raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")
    frames = [require_columns(spark.read.parquet(p), columns).select(*columns) for p in paths]
    return reduce(DataFrame.unionByName, frames)


def sample_parquet(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """chunk_text of the first ``limit`` rows; one column is scanned."""
    df = spark.read.parquet(path)
    return df.select(df[pick_column(df)].alias("chunk_text")).limit(limit)


def read_csv(spark: SparkSession, path: str, limit: int | None = 5000, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.limit(limit) if limit else df


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; written from ``compute`` if it isn't there."""
    if not _exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)


@cache
def load_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def extract_zip(archive: str, folder: str) -> list[str]:
    """Driver-side preparation: unpack an archive, refusing paths that leave the folder."""
    import os

    with zipfile.ZipFile(archive) as z:
        root = os.path.realpath(folder)
        for name in z.namelist():
            if os.path.commonpath([root, os.path.realpath(os.path.join(root, name))]) != root:
                raise ValueError(f"unsafe path in archive: {name}")
        z.extractall(folder)
        return z.namelist()
