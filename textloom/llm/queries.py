"""The registered queries of the subpackage, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, cover_tree, decontaminate, langid, lm_scoring, mixing, repair, secrets, sharding, simhash, trie, url_rules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.op1_top5(_table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2_secrets(_table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op5_rendezvous(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op6_langid(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.op7_rules(_table(spark, sf_dir, "pages"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op8_warc(_table(spark, sf_dir, "pages"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9_mix(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op11_repairs(_table(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op12_trie(_table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs it

    return bpe.op13_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_top_k, op2_secret_scan, op3_lm_score, op4_decontaminate, op5_shard,
        op6_language_id, op7_url_filter, op8_warc_round_trip, op9_mix_sources, op10_simhash,
        op11_repair, op12_prefix_trie, op13_bpe,
    )
    return {op.__name__: op for op in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": cover_tree.ORACLE,
        "op5_shard": sharding.oracle(),
        "op7_url_filter": url_rules.oracle(),
        "op8_warc_round_trip": warc.ORACLE,
        "op9_mix_sources": mixing.oracle(),
        "op11_repair": repair.oracle(),
        "op12_prefix_trie": trie.oracle(),
    }
