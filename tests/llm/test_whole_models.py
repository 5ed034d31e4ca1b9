"""The language models hold every word and bigram; language scores equal sums over dictionaries of subwords."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_scans import brute_scores

from textloom.llm import langid, lm_scoring, queries


def held_to_brute_force(spark, rows, targets):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = spark.createDataFrame([(i,) for i in targets], "doc_id bigint")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(df, ids).collect()}
    want = brute_scores(rows, set(targets))
    assert len(got) == len(want)
    for i, (n, t, b) in want.items():
        assert got[i].tokens == n
        if n:
            assert (got[i].target_loss, got[i].background_loss, got[i].score) == pytest.approx((t, b, t - b))


def test_rare_words_count(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(lm_scoring, "SHARE_TOKENS", 5_000)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["the"] * 200 + [f"w{x}" for x in rng.integers(0, 60_000, 600)])) for i in range(150)]  # a word of one token is under 2e-5 of all
    held_to_brute_force(spark, rows, list(range(0, 150, 4)))


def test_scores_of_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").where(~F.col("text").rlike("[^\\x00-\\x7f]")).collect()]
    good = [r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()]
    held_to_brute_force(spark, rows, good)


def test_repeats_and_long_texts(spark, monkeypatch):
    long = " ".join(f"w{i % 97} v{i % 31}" for i in range(300_000))
    same = "an exact copy of a target document"
    rows = [(0, same), (1, same), (2, same), (3, long), (4, "zz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = spark.createDataFrame([(0,), (1,)], "doc_id bigint")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(df.union(df.where("doc_id = 2")), ids).collect()}
    assert got[3].tokens == 600_000 and got[0].target_loss == got[1].target_loss and got[0].score > 0  # two copies of it are background, one other is target
    for i, (n, t, b) in brute_scores([*rows, (2, same)], {0, 1}).items():
        assert (got[i].tokens, got[i].target_loss, got[i].background_loss) == (n, pytest.approx(t), pytest.approx(b))


def test_counts_are_packed_whole():
    counts = np.array([0, 1, 254, 255, 256, 10**12, 0, 255])
    assert (lm_scoring.unpack(lm_scoring.pack(counts), len(counts)) == counts).all() and len(lm_scoring.unpack(b"", 0)) == 0
    for size in (1, 256, 257, 65536, 70000, 1 << 25):
        at = np.array([0, size - 1, size // 2])
        assert (lm_scoring._unplaned(lm_scoring._planes(at, size), 3) == at).all()


def test_registered_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    want = brute_scores(rows, good)
    got = {r.doc_id: r for r in queries.op3_lm_score(spark, small).collect()}
    assert set(got) == set(want) and len(got) == 200
    for i, (n, t, b) in want.items():
        assert (got[i].tokens, got[i].target) == (n, i in good)
        assert got[i].score == (pytest.approx(t - b) if n else None)


def plain_bucket(part):
    """The bucket of a subword's bytes."""
    h, mask = 0, 0xFFFFFFFF
    for byte in part:
        h = (h << 8 | byte) & mask
    h = (h ^ len(part)) * 0x9E3779B1 & mask
    h = (h ^ h >> 15) * 0x85EBCA77 & mask
    return h >> 17


def plain_subwords(text):
    """Counts of the 2 to 4 byte subwords of a text of letters, digits and ASCII signs: letters lower-cased, all else a mark."""
    data = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode())
    out = Counter()
    for n in langid.WIDTHS:
        for i in range(len(data) - n + 1):
            part = data[i : i + n]
            middle = part[1:-1] if n > 2 else part.strip(b" ")[:1]
            if middle and 32 not in middle:
                out[part] += 1
    return out


def test_language_scores_equal_dictionaries_of_subwords(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs, langid.learnable(F.col("id")))
    texts = [r.text for r in docs.collect() if not set(r.text) & set("\u00a0¡«·»¿“”‘’–—…•")][:120] + ["", "a", "ab1cd_é", "1 2", "Hello ", "É"]
    p, typical = model.scores(pa.array(texts))
    for k, text in enumerate(texts):
        counts = plain_subwords(text)
        n = max(1, sum(counts.values()))
        logit = sum((c * model.logits[plain_bucket(x)] for x, c in counts.items()), np.zeros(len(model.labels))) / n
        kind = sum((c * model.typical[plain_bucket(x)] for x, c in counts.items()), np.zeros(len(model.labels))) / n
        z = np.exp((logit + model.bias) / model.temperature - ((logit + model.bias) / model.temperature).max())
        assert p[k] == pytest.approx(z / z.sum(), abs=1e-4), text[:60]
        assert typical[k] == pytest.approx(kind + langid.DOUBT * langid.spread(model.typical) / np.sqrt(n), abs=1e-4), text[:60]
    names, score, _ = model.judge(pa.array(texts))
    assert names[-6:] == [langid.UND, names[-5], names[-4], langid.UND, names[-2], names[-1]] and langid.UND not in names[:-6]
    assert all(s == pytest.approx(max(q)) for s, q, name in zip(score, p, names, strict=True) if name != langid.UND)


@pytest.mark.parametrize("scale_bytes", [1, 20_000])
def test_larger_chunks_and_shares_give_the_same_scores(spark, small, monkeypatch, scale_bytes):
    monkeypatch.setattr(lm_scoring, "SCALE_BYTES", scale_bytes)
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(lm_scoring, "SHARE_TOKENS", 300)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["the"] * 9 + [f"w{x}" for x in rng.integers(0, 900, 60)])) for i in range(120)]
    held_to_brute_force(spark, rows, list(range(0, 120, 5)))


def test_exchanged_rows_grow_with_the_corpus():
    pairs = lambda size: (size / (lm_scoring.CHUNK_BYTES * lm_scoring.scale(size))) * (size / (6 * lm_scoring.SHARE_TOKENS * lm_scoring.scale(size)))
    assert lm_scoring.scale(30 << 20) == lm_scoring.scale(0) == 1
    assert pairs(100 << 40) / pairs(1 << 40) == pytest.approx(100) and lm_scoring.scale(100 << 40) * lm_scoring.CHUNK_BYTES < 450e6
