"""The pipeline's near copies against brute-force Jaccard similarity."""

import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import langid, mixing, near_copies, sharding


def brute_leads(docs):
    """Ids that stay: the least of each component of pairs with a five-word Jaccard similarity of 0.8 or more."""
    words = [t.lower().split() for _, t in docs]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return {min(d for (d, _), y in zip(docs, label, strict=True) if y == x) for x in label}


def kept(spark, docs):
    df = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())


def test_near_dedup_finds_all_pairs_of_similarity_08(spark):
    rng = np.random.default_rng(11)
    docs = []
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        docs.append((base * 100, " ".join(words)))
        for copy in range(1, 9):  # one to eight words changed: similarity about 0.97 down to 0.77
            changed = list(words)
            for at in rng.choice(300, copy, replace=False):
                changed[at] = f"x{base}"
            docs.append((base * 100 + copy, " ".join(changed)))
    chain = [f"c{x}" for x in range(200)]  # neighbours are near copies, the ends aren't
    docs += [(5000 + k, " ".join(chain[6 * k :] + [f"d{x}" for x in range(6 * k)])) for k in range(8)]
    docs += [(9000, "one two three"), (9001, "One two three"), (9002, "one two four")]
    assert kept(spark, docs) == sorted(brute_leads(docs))


def test_near_dedup_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600).collect() if r.text and r.text.strip()]
    assert kept(spark, docs) == sorted(brute_leads(docs))


def test_bands_of_a_set_do_not_depend_on_its_neighbours():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, near_copies.PIECE + 7, 300)]
    together = near_copies.band_hashes(sets)
    assert all((near_copies.band_hashes([s])[0] == row).all() for s, row in zip(sets, together, strict=True))


def test_pipeline_equals_brute_force_with_jaccard_near_copies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, small).collect()))
    model = langid.train(docs, langid.learnable(F.col("id")))
    rows = docs.collect()
    accepted = model.judge(pa.array([r.text for r in rows]))[2]
    rows = [r for r, ok in zip(rows, accepted, strict=True) if ok]
    leads = brute_leads([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if r.doc_id in leads]
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in words(r.text) for i in items)]
    con = duckdb.connect()
    con.register("kept", pa.Table.from_pylist([r.asDict() for r in rows]))
    mixed = con.sql(mixing.oracle(1, "kept", "c.* EXCLUDE (domain, tokens, crc, epoch, seed_order, before)")).to_arrow_table()
    con.register("mixed", mixed)
    want = con.sql(sharding.oracle(16, "mixed")).to_arrow_table().select(["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    assert got == sorted(tuple(r.values()) for r in want.to_pylist())


def test_near_fingerprints_link_without_bands(spark):
    words = [f"w{x}" for x in np.random.default_rng(3).integers(0, 5000, 4000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words[::-1]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    content = F.xxhash64("doc_id", "text")
    marked = near_copies.marks(df, "doc_id", "text", content).withColumn("bands", F.array(F.xxhash64("fp"))).persist()
    ids = {r.doc_id: r.fp for r in marked.collect()}
    found = {r.fp for r in near_copies.links(df, marked, "text", content).collect()}
    assert found == {ids[1], ids[2]}
