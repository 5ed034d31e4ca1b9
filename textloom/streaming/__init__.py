"""Streaming counterparts of the row-wise functions and of exact deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.cleaning import Options, normalize
from textloom.functions.tokens import n_white_words


def read_documents(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_stream(stream: DataFrame, text: str = "text", options: Options = Options(), min_words: int = 10) -> DataFrame:  # noqa: B008
    """Cleaned texts with enough words; stateless."""
    return stream.withColumn(text, normalize(F.col(text), options)).withColumn("n_words", n_white_words(F.col(text))).where(F.col("n_words") >= min_words)


def dedup_stream(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Exact duplicates within the watermark; state is bounded by ``delay``, so later copies pass."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
