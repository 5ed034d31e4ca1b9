"""Sinks: Parquet, partitioned Parquet, CSV and ZIP."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame

from textloom.sources.roots import RootsSink


def write_parquet(df: DataFrame, path: str, partitions: int | None = None) -> None:
    (df.coalesce(partitions) if partitions else df).write.mode("overwrite").parquet(path)


def write_by_label(df: DataFrame, roots: Sequence[str], label: str = "label", mode: str = "overwrite") -> None:
    """One folder per label below each root; the label stays a column of the files, too.

    The plan runs once for all roots, and they change together or not at all
    (see ``roots``).
    """
    if roots:
        df.sparkSession.dataSource.register(RootsSink)
        df.write.format(RootsSink.name()).mode(mode).option("roots", json.dumps(list(roots))).option("label", label).save()


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; values keep their blanks, and quotes in them are doubled."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def zip_texts(df: DataFrame, name: str, text: str) -> bytes:
    """A ZIP of ``<stem>_clean.txt`` files, for downloads; rows come to the driver a partition at a time."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for row in df.select(name, text).toLocalIterator():
            stem = re.sub(r"\.[^.]*$", "", row[0].rsplit("/", 1)[-1])
            z.writestr(f"{stem}_clean.txt", row[1] or "")
    return buffer.getvalue()
