"""A directory-listing web API, mirrored version by version: a run fetches only files that are new or have changed.

Folders are listed on executors, a level of the tree a job, and files fetched
there, each with a few tries. What is known is an index of (path, tag, digest),
written whole with every version; a file is fetched if its path is new or its tag
(``sha``, ``etag``, or size and time of the listing) isn't the known one, and
kept if its content's digest isn't. A file without a tag is fetched every time.

A version is committed by moving its files into ``files/version=<n>``, after its
index has been written; a run that dies before leaves nothing that counts, and the
next one makes the same version again. A file that couldn't be fetched stays out
of the index, so it is tried again; ``failures`` lists it. So every change comes
once, also to a stream that reads ``files``.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import written
from textloom.sources.listing import _fetch

ENTRIES = "kind string, path string, url string, tag string"
FILES = "path string, tag string, digest string, body binary, error string"
INDEX = "path string, tag string, digest string"
Fetch = Callable[[str], bytes]


def persistent(fetch: Fetch, tries: int, wait: float) -> Fetch:
    """``fetch`` with further tries after doubling waits; the last error is raised."""

    def get(url: str) -> bytes:
        for k in range(tries):
            try:
                return fetch(url)
            except Exception:
                if k + 1 == tries:
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError

    return get


def tag_of(entry: dict) -> str | None:
    """What tells a file's contents apart in a listing, if it says so."""
    for name in ("sha", "etag"):
        if entry.get(name):
            return str(entry[name])
    parts = [str(entry[n]) for n in ("size", "last_modified", "modified", "updated") if entry.get(n) is not None]
    return ":".join(parts) if len(parts) > 1 else None


def _listed(folders: DataFrame, fetch: Fetch, suffix: str) -> DataFrame:
    """ENTRIES of (prefix, url) folders: their files of the suffix, and their folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefix, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for entry in json.loads(fetch(url)):
                    path = f"{prefix}{entry['name']}"
                    if entry["type"] == "dir":
                        rows.append(("dir", f"{path}/", entry["url"], None))
                    elif path.lower().endswith(suffix):
                        rows.append(("file", path, entry["download_url"], tag_of(entry)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["kind", "path", "url", "tag"])

    return folders.select("path", "url").mapInArrow(run, ENTRIES)


def tree(spark: SparkSession, url: str, suffix: str = ".txt", fetch: Fetch = _fetch, tasks: int = 8) -> DataFrame:
    """(path, url, tag) of all files below a listing; a folder that is reached twice is listed once."""
    folders = spark.createDataFrame([("dir", "", url, None)], ENTRIES)
    seen, files = folders.select("url"), spark.createDataFrame([], ENTRIES)
    while True:
        found = written(_listed(folders.repartition(tasks, "url"), fetch, suffix), "listing")
        files = files.union(found.where("kind = 'file'"))
        folders = written(found.where("kind = 'dir'").dropDuplicates(["url"]).join(seen, "url", "left_anti").select("kind", "path", "url", "tag"), "folders")
        if folders.isEmpty():
            return files.select("path", "url", "tag").dropDuplicates(["path"])
        seen = seen.union(folders.select("url"))


def _fetched(files: DataFrame, fetch: Fetch) -> DataFrame:
    """FILES of (path, url, tag) rows, a body or an error each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, url, tag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    body, error = fetch(url), None
                except Exception as e:
                    body, error = None, f"{type(e).__name__}: {e}"
                digest = hashlib.sha256(body).hexdigest() if body is not None else None
                values = ((path, pa.string()), (tag, pa.string()), (digest, pa.string()), (body, pa.binary()), (error, pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], ["path", "tag", "digest", "body", "error"])

    return files.select("path", "url", "tag").mapInArrow(run, FILES)


class Mirror:
    """A mirror of a listing below a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        home = self._paths(f"{self.folder}/files")
        names = [s.getPath().getName() for s in self._files.listStatus(home)] if self._files.exists(home) else []
        return max((int(n.partition("=")[2]) for n in names if n.startswith("version=")), default=0)

    def index(self, version: int | None = None) -> DataFrame:
        """(path, tag, digest) of the files as of a version."""
        version = self.version() if version is None else version
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index/{version:06d}") if version else self.spark.createDataFrame([], INDEX)

    def changes(self, since: int = 0) -> DataFrame:
        """(path, text, version) of what versions after ``since`` have brought; undecodable bytes are dropped."""
        if not self.version():
            return self.spark.createDataFrame([], "path string, text string, version int")
        rows = self.spark.read.schema("path string, digest string, body binary, version int").parquet(f"{self.folder}/files").where(F.col("version") > since)
        return rows.select("path", F.replace(F.make_valid_utf8(F.col("body").cast("string")), F.lit("�"), F.lit("")).alias("text"), "version")

    def failures(self) -> DataFrame:
        """(path, error) of the last version's files that couldn't be fetched."""
        version = self.version()
        return self.spark.read.schema("path string, error string").parquet(f"{self.folder}/failures/{version:06d}") if version else self.spark.createDataFrame([], "path string, error string")

    def sync(self, url: str, suffix: str = ".txt", tries: int = 3, wait: float = 1.0, tasks: int = 8, fetch: Fetch = _fetch) -> int:
        """Mirror the listing's present state as a new version, and return its number.

        A folder that can't be listed fails the run, which then has no effect.
        """
        get, last = persistent(fetch, tries, wait), self.version()
        new, known = last + 1, self.index(last)
        files = written(tree(self.spark, url, suffix, get, tasks), "tree")
        before = known.select("path", F.col("tag").alias("old_tag"), F.col("digest").alias("old_digest"))
        met = files.join(before, "path", "left")
        same = F.col("tag").isNotNull() & F.col("tag").eqNullSafe(F.col("old_tag"))
        got = written(_fetched(met.where(~same).repartition(tasks, "path"), get), "fetched")
        staged = f"{self.folder}/_staged-{new:06d}"
        fresh = got.where("error IS NULL").join(before.select("path", "old_digest"), "path", "left").where(~F.col("digest").eqNullSafe(F.col("old_digest")))
        fresh.select("path", "digest", "body").write.mode("overwrite").parquet(staged)
        kept = met.where(same).select("path", "tag", F.col("old_digest").alias("digest"))
        kept.union(got.where("error IS NULL").select("path", "tag", "digest")).write.mode("overwrite").parquet(f"{self.folder}/index/{new:06d}")
        got.where("error IS NOT NULL").select("path", "error").write.mode("overwrite").parquet(f"{self.folder}/failures/{new:06d}")
        self._files.mkdirs(self._paths(f"{self.folder}/files"))
        if not self._files.rename(self._paths(staged), self._paths(f"{self.folder}/files/version={new}")):
            raise RuntimeError(f"version {new} couldn't be moved into place")
        return new
