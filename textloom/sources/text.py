"""Text trees: one row per file.

Folders are listed and files read on executors, so the driver holds no list of
files. A store that Arrow doesn't reach is read by Spark's own reader, which
lists files on the driver and leaves out empty ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from textloom.functions.labels import source_of, stem
from textloom.session import small_batches, written
from textloom.sources.stores import store

TXT = "*.[tT][xX][tT]"
TXT_OR_MD = "*.{txt,md}"
#: Bytes of files that a task reads, about, whatever their number.
TASK_BYTES = 64 << 20
#: Entries or texts, and characters of texts, in an Arrow batch.
ROWS, CHARACTERS = 1000, 1 << 20


def _dropping(body: bytes) -> str:
    return body.decode("utf-8", "ignore")


def _falling_back(body: bytes) -> str:
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("latin-1")


DECODERS = {"drop": _dropping, "latin-1": _falling_back}


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath) and fs.getFileStatus(jpath).isDirectory()


def _qualified(spark: SparkSession, path: str) -> str:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jpath).toString().rstrip("/")


def _reached(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path of a URI as Spark prints it, in which nothing is quoted."""
    return (pyarrow.fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)) if uri.startswith("file:") else store(uri)


def _by_arrow(uri: str) -> bool:
    try:
        _reached(uri)
    except (pa.ArrowException, OSError, NotImplementedError):
        return False
    return True


def _patterns(glob: str) -> list[str]:
    """The patterns without braces that a glob stands for."""
    found = re.fullmatch(r"(.*?)\{([^{}]*)\}(.*)", glob)
    return [p for choice in found[2].split(",") for p in _patterns(found[1] + choice + found[3])] if found else [glob.replace("[^", "[!")]


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of the name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(files: pyarrow.fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, whether a folder, size) of what lies in a folder; a local one is never held as a whole."""
    if isinstance(files, pyarrow.fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                yield e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size
    else:
        for e in files.get_file_info(pyarrow.fs.FileSelector(folder)):
            yield e.base_name, e.type == pyarrow.fs.FileType.Directory, e.size or 0


def _listed(folders: DataFrame, root: str, glob: str) -> DataFrame:
    """(folder, path, size), paths below ``root``: folders in ``folders``, and files whose names match."""
    patterns = _patterns(glob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _reached(root)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.string(), pa.int64()), strict=True)], ["folder", "path", "size"])
        rows: list[tuple[bool, str, int]] = []
        for batch in batches:
            for below in batch.column(0).to_pylist():
                for name, folder, size in _entries(files, base + below):
                    if not _hidden(name) and (folder or any(fnmatchcase(name, p) for p in patterns)):
                        rows.append((folder, f"{below}/{name}", size))
                    if len(rows) >= ROWS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return folders.select("path").mapInArrow(run, "folder boolean, path string, size bigint")


def _walked(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, size), paths below ``root``, of the files whose names match; a level of the tree is a job."""
    tasks, found, level = 3 * spark.sparkContext.defaultParallelism, None, spark.range(1).select(F.lit("").alias("path"))
    while found is None or not level.isEmpty():
        listed = written(_listed(level if found is None else level.repartition(tasks), root, glob), "listed")
        files = listed.where("not folder").select("path", "size")
        found, level = files if found is None else found.unionByName(files), listed.where("folder").select("path")
    return found


def list_files(spark: SparkSession, folder: str, glob: str = TXT) -> DataFrame:
    """(path, size): files below ``folder`` whose names match; contents aren't read."""
    if _exists(spark, folder) and _by_arrow(root := _qualified(spark, folder)):
        return _walked(spark, root, glob).select(F.concat(F.lit(root), "path").alias("path"), "size")
    return _by_spark(spark, folder, glob).select("path", F.col("length").alias("size"))


def _by_spark(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)


def _in_few_tasks(files: DataFrame) -> DataFrame:
    """``files`` in tasks of some TASK_BYTES: Spark counts each file as four megabytes, so small ones would make a task of every 32."""
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return files.coalesce(max(3 * files.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))


def _texts(rows: DataFrame, body: Callable[[], Callable], decode: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of (path, content) rows, where ``body()`` makes what gives a content's bytes; batches are bounded by rows and characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = body()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "text"])
        paths: list[str] = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                paths.append(path.as_py())
                texts.append(decode(get(content.as_py())))
                held += len(texts[-1])
                if len(texts) >= ROWS or held >= CHARACTERS:
                    yield batch_of()
                    paths, texts, held = [], [], 0
        if texts:
            yield batch_of()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "path string, text string")


def _opened(root: str) -> Callable[[], Callable[[str], bytes]]:
    def body() -> Callable[[str], bytes]:
        files, base = _reached(root)

        def get(path: str) -> bytes:
            with files.open_input_stream(base + path, compression=None) as f:
                return f.read()

        return get

    return body


def read_texts(spark: SparkSession, folder: str, glob: str = TXT, undecodable: str = "drop", required: bool = False) -> DataFrame:
    """(path, text) of the files below ``folder``, whole.

    ``undecodable`` bytes are dropped, or the file is read as Latin-1. With
    ``required``, a missing folder or one without such files is an error.
    """
    there = _exists(spark, folder)
    if required and not there:
        raise FileNotFoundError(f"no such folder: {folder}")
    if there and _by_arrow(root := _qualified(spark, folder)):
        files = _walked(spark, root, glob)
        n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if required and not n:
            raise ValueError(f"no text files in {folder}")
        files = files.repartition(max(3 * spark.sparkContext.defaultParallelism, size // TASK_BYTES))
        return _texts(files.select(F.concat(F.lit(root), "path").alias("path"), F.col("path").alias("content")), _opened(root), DECODERS[undecodable])
    try:
        files = _by_spark(spark, folder, glob)
    except AnalysisException:
        if required:
            raise FileNotFoundError(f"no such folder: {folder}") from None
        raise
    if required and files.select("path").isEmpty():
        raise ValueError(f"no text files in {folder}")
    return _texts(_in_few_tasks(files).select("path", "content"), lambda: bytes, DECODERS[undecodable])


def relative(path: Column, root: str) -> Column:
    """A file's path below ``root``, either with or without a scheme."""
    root = re.sub("^[a-z0-9]+:/*", "/", root.rstrip("/"))
    return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:/*", "/"), f"^\\Q{root}\\E/", "")


def documents(spark: SparkSession, root: str, label: str) -> DataFrame:
    """(doc_id, text, label, source, s3_key) of ``root/label/source/name.txt``."""
    files = read_texts(spark, f"{root.rstrip('/')}/{label}")
    key = relative(F.col("path"), root)
    return files.select(stem(key).alias("doc_id"), "text", F.lit(label).alias("label"), source_of(key, label).alias("source"), key.alias("s3_key"))


def folder_counts(paths: DataFrame, levels: Sequence[str] = ("label", "split", "subfolder"), path: str = "path") -> DataFrame:
    """Files by their first path segments, with subtotals (null below the level they are of)."""
    parts = F.split(F.col(path), "/")
    segments = [F.when(F.size(parts) > i + 1, F.get(parts, F.lit(i))).otherwise("").alias(name) for i, name in enumerate(levels)]
    return paths.select(*segments).rollup(*levels).agg(F.count("*").alias("n"))
