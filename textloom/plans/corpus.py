"""The corpus build: clean, filter, deduplicate, cap, split and chunk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import chunking, cleaning, labels, scoring
from textloom.functions.let import let
from textloom.functions.tokens import n_white_words
from textloom.operators.sampling import cap_groups, drop_duplicates, stratified_split
from textloom.sources import sinks, text


@dataclass(frozen=True)
class Settings:
    min_words: int = 10
    group_cap: int = 4000
    test_fraction: float = 0.2
    chunk_words: int = 300
    seed: int = 42


def clean_documents(raw: DataFrame, settings: Settings = Settings(), unicode: bool = True) -> DataFrame:  # noqa: B008
    """``raw`` (with ``text``) cleaned, without texts of too few words, with n_chars and n_words."""
    # Exploding an array of one or no row keeps the filter above the chain; a predicate would be pushed
    # below the projection and run the chain a second time.
    row = let(cleaning.clean(F.col("text"), unicode), lambda t: F.struct(t.alias("text"), F.length(t).cast("bigint").alias("n_chars"), n_white_words(t).alias("n_words")))
    kept = F.filter(F.array(row), lambda r: (r["text"] != "") & (r["n_words"] >= settings.min_words))
    others = [c for c in raw.columns if c not in ("text", "n_chars", "n_words")]
    return raw.select(*others, F.explode(kept).alias("__row")).select(*others, "__row.*")


def deduplicate(docs: DataFrame, order: str = "s3_key") -> DataFrame:
    """The first document of each text within a label; the same text may stay under two labels."""
    return drop_duplicates(docs, ["label", "text"], [order])


def dedup_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(label, n_before, n_after, n_dropped)."""
    b, a = (df.groupBy("label").agg(F.count("*").alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    return b.join(a, "label", "left").select("label", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"), (F.col("n_before") - F.coalesce("n_after", F.lit(0))).alias("n_dropped"))


def units(docs: DataFrame, words: int = 300) -> DataFrame:
    """One row per chunk: the document's columns with unit_id, the chunk's text and its counts."""
    parts = docs.withColumn("__parts", chunking.chunks(F.col("text"), words)).select(*(c for c in docs.columns if c != "text"), F.posexplode("__parts").alias("__i", "__c"))
    unit = F.concat(F.col("doc_id").cast("string"), F.lit("_c"), F.col("__i").cast("string"))
    return parts.withColumns({"unit_id": unit, "text": F.col("__c.text"), "n_chars": F.length("__c.text").cast("bigint"), "n_words": F.col("__c.tokens")}).drop("__i", "__c")


def build(raw: DataFrame, settings: Settings = Settings(), order: str = "s3_key") -> dict[str, DataFrame]:  # noqa: B008
    """All outputs of the job, lazily: clean documents by label, the split, and its chunks."""
    clean = deduplicate(clean_documents(raw, settings), order)
    split = split_documents(clean, settings, order)
    return _by_label(clean) | _by_split("main", split) | _by_split("augmented", units(split, settings.chunk_words))


def split_documents(clean: DataFrame, settings: Settings, order: str) -> DataFrame:
    capped = cap_groups(clean, ["label", "source"], settings.group_cap, order, settings.seed)
    return stratified_split(capped, ["label", "source"], order, settings.test_fraction, settings.seed)


def _by_label(clean: DataFrame) -> dict[str, DataFrame]:
    return {"no_pls_clean": clean.where(F.col("label") == labels.TECHNICAL), "pls_clean": clean.where(F.col("label") == labels.PLAIN)}


def _by_split(name: str, split: DataFrame) -> dict[str, DataFrame]:
    return {f"{name}_{side}": split.where(F.col("split") == side) for side in ("train", "test")}


def run(spark: SparkSession, root: str, out: str, settings: Settings = Settings()) -> dict[str, DataFrame]:  # noqa: B008
    """Read ``root/<label>/<source>/*.txt`` and write every output below ``out``; returns them as written.

    Each step starts from the tables that the one before wrote, so texts are
    cleaned and grouped once, for a table that the outputs are filtered from.
    """
    raw = text.documents(spark, root, labels.TECHNICAL).unionByName(text.documents(spark, root, labels.PLAIN))
    out, order = out.rstrip("/"), "s3_key"

    def written(name: str, df: DataFrame) -> DataFrame:
        sinks.write_parquet(df, f"{out}/{name}.parquet")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}.parquet")

    clean = written("clean", deduplicate(clean_documents(raw, settings), order))
    outputs = {name: written(name, df) for name, df in _by_label(clean).items()}
    split = written("main", split_documents(clean, settings, order))
    outputs |= {name: written(name, df) for name, df in _by_split("main", split).items()}
    for side in ("train", "test"):
        outputs[f"augmented_{side}"] = written(f"augmented_{side}", units(outputs[f"main_{side}"], settings.chunk_words))
    return outputs


def process_directory(
    spark: SparkSession, folder: str, options: cleaning.Options = cleaning.Options(), chunk_tokens: int = 120, overlap: int = 20, config: dict | None = None  # noqa: B008
) -> dict[str, DataFrame]:
    """``documents`` (path, stats, label, preview) and ``chunks`` of a folder of .txt and .md files."""
    rules = (config or {}).get("labeling", {})
    files = text.read_texts(spark, folder, text.TXT_OR_MD, "latin-1", required=True)
    path = text.relative(F.col("path"), folder)
    label = labels.label_of(path, rules.get("pls_patterns") or (), rules.get("no_pls_patterns") or (), rules.get("default_label", "NO_PLS"))
    cleaned = files.select(path.alias("source_path"), F.col("text").alias("original"), cleaning.normalize(F.col("text"), options, unicode=True).alias("cleaned"), label.alias("label"))
    parts = cleaned.withColumn("parts", chunking.chunks(F.col("cleaned"), chunk_tokens, overlap))
    docs = parts.select("source_path", "label", "cleaned", scoring.summarize(F.col("original"), F.col("cleaned")).alias("stats"), chunking.preview(F.col("parts")).alias("preview"))
    rows = parts.select("source_path", "label", F.posexplode("parts").alias("i", "c"))
    chunks = rows.select(
        chunking.chunk_id(F.col("source_path"), F.col("i")).alias("document_id"), F.col("c.text").alias("chunk_text"), "label", "source_path", F.col("c.tokens").alias("tokens")
    )
    return {"documents": docs, "chunks": chunks}


def summary_rows(docs: DataFrame) -> DataFrame:
    """Tokens before and after, and the reduction, of ``process_directory``'s documents."""
    s = F.col("stats")
    return docs.select("source_path", "label", s["original"]["tokens"].alias("tokens_before"), s["processed"]["tokens"].alias("tokens_after"), s["token_reduction_pct"].alias("token_reduction_pct"))


def persist_chunks(chunks: DataFrame, config: dict) -> list[str]:
    """Write chunks under the column names and to the roots that the configuration's ``io`` section gives."""
    io = config.get("io", {})
    names = {"document_id": io.get("id_col", "document_id"), "chunk_text": io.get("text_col", "chunk_text"), "label": io.get("label_col", "label")}
    roots = [r for r in (io.get("local_output_dir"), io.get("s3_output_prefix")) if r]
    sinks.write_by_label(chunks.withColumnsRenamed(names), roots, names["label"])
    return roots
