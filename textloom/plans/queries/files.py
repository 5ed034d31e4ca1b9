"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.queries import common as C
from textloom.session import shared_folder
from textloom.sources import sinks, tables, text

R = C.Registry()

#: Folders that the Latin-1 files are dealt over.
FOLDERS = 64
_LABEL = "CASE WHEN doc_id % 2 = 0 THEN 'pls' ELSE 'no_pls' END"


def _write_tree(rows: DataFrame, root: str) -> None:
    """Write (path, body) rows as files below a folder; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root else root.replace(":", "://", 1))
        made: set[str] = set()
        for batch in batches:
            for path, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(body)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.select("path", "body").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def _path(label: Column, ending: Column) -> Column:
    return F.concat_ws("/", label, F.coalesce("source", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), ending))


@R.add(f"SELECT doc_id::VARCHAR AS doc_id, {_LABEL} AS label, coalesce(source, 'unknown') AS source, md5(text) AS body, length(text)::BIGINT AS n FROM documents")
def q74_text_tree(spark, d):
    """A tree of label/source/file, some files with undecodable bytes or another ending's case, next to files that are no texts."""
    root = f"{shared_folder(spark)}/tree-{C.fresh()}"
    docs = C.documents(spark, d)
    ending = F.when(F.col("doc_id") % 3 == 0, ".TXT").otherwise(".txt")
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8"))
    _write_tree(docs.select(_path(F.expr(_LABEL), ending).alias("path"), body.alias("body")), root)
    _write_tree(docs.where("doc_id % 10 = 0").select(_path(F.expr(_LABEL), F.lit(".json")).alias("path"), F.lit(b"{}").alias("body")), root)
    read = text.documents(spark, root, "pls").unionByName(text.documents(spark, root, "no_pls"))
    return read.select("doc_id", "label", "source", F.md5(F.encode("text", "UTF-8")).alias("body"), F.length("text").cast("bigint").alias("n"))


@R.add("SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS name, md5(text) AS body FROM documents")
def q75_latin_1_files(spark, d):
    """Texts that Latin-1 can hold are written in it, unless they would pass for UTF-8, and read back by the fallback, others in UTF-8."""
    root = f"{shared_folder(spark)}/latin-{C.fresh()}"
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt"))
    latin = F.when(F.col("text").rlike(r"\A[\x00-\xFF]*\z"), F.encode("text", "ISO-8859-1"))
    plain = latin.isNotNull() & ~F.is_valid_utf8(latin.cast("string"))
    # Folders of a bounded share of the files each, so that no task lists them all.
    path = F.concat_ws("/", F.pmod("doc_id", F.lit(FOLDERS)).cast("string"), name)
    docs = C.documents(spark, d).select(path.alias("path"), F.when(plain, latin).otherwise(F.encode("text", "UTF-8")).alias("body"))
    _write_tree(docs, root)
    read = text.read_texts(spark, root, text.TXT_OR_MD, "latin-1", required=True)
    return read.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.md5(F.encode("text", "UTF-8")).alias("body"))


@R.add(f"SELECT doc_id::VARCHAR AS doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS body, {_LABEL} AS label FROM documents")
def q76_parquet_and_csv(spark, d):
    """Parquet by label, a union that skips missing tables, and CSV, which keeps all but the kind of line ends."""
    root = f"{shared_folder(spark)}/tables-{C.fresh()}"
    docs = C.documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.expr(_LABEL).alias("label"))
    sinks.write_by_label(docs, [f"{root}/labels"])
    for label in ("pls", "no_pls"):
        sinks.write_parquet(spark.read.parquet(f"{root}/labels").where(F.col("__label") == label).drop("__label"), f"{root}/{label}.parquet")
    sinks.write_csv(tables.read_parquets(spark, root, ["absent.parquet", "pls.parquet", "no_pls.parquet"]), f"{root}/csv")
    read = tables.read_csv(spark, f"{root}/csv", None, "doc_id string, text string, label string")
    ends = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return read.select("doc_id", F.md5(F.encode(ends, "UTF-8")).alias("body"), "label")


@R.add("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars, least(50, count(*)) AS sampled FROM documents")
def q77_cached_table(spark, d):
    """A table that is computed once and then read, and a bounded sample of its text column."""
    path = f"{shared_folder(spark)}/cached-{C.fresh()}"
    first = tables.load_or_compute(spark, path, lambda: C.documents(spark, d).select("doc_id", "text"))
    again = tables.load_or_compute(spark, path, lambda: first.limit(0))
    sampled = tables.sample_parquet(spark, path, 50).agg(F.count("chunk_text").alias("sampled"))
    return again.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).join(F.broadcast(sampled))
