"""The training-corpus pipeline: five stages over ``documents``, each of one operator.

Every stage takes (spark, docs, sf_dir), docs being what its predecessor kept,
and returns a DataFrame; all but the last return the columns of documents.

Defined results, on top of the operators': null and letterless texts go in the
first stage; rows that repeat in all columns are one row after the second; long
texts are judged whole; columns other than those of documents are dropped at the
start of a stage, so their names can't clash; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, langid, mixing, near_copies, sharding
from textloom.llm.scratch import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Equal tokens of a run for which a document goes; items of fewer words are common phrases as likely as not.
DECISIVE = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, learnt from this stage's input, doesn't reject."""
    docs = docs.select(*COLUMNS)
    return langid.accepted_documents(docs, langid.train(docs, langid.learnable(F.col("id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the least by doc_id, then by content hash.

    Candidates come by SimHash (tiled exact comparison, as in op10_simhash), then by
    minimum hashes, as fingerprints miss many such copies (see
    textloom.llm.near_copies); all are confirmed on the shingles.
    """
    return near_copies.deduplicate(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of DECISIVE equal tokens or more with a benchmark passage."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), decisive=DECISIVE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens by the tree's weights, each document once at most."""
    return mixing.mixed_documents(docs.select(*COLUMNS), 1).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard of 16, and its shard of 17."""
    return sharding.op5_rendezvous(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Language ID and near-dedup can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
