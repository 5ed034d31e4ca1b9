"""Column functions against restatements in plain Python."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import chunking, cleaning, generation, labels, metrics, scoring, tokens


def column(spark, texts, build):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.x for r in df.select("i", build(F.col("text")).alias("x")).orderBy("i").collect()]


CRAFTED = {
    "aged <17 years got 1) body weight >=30 kg": "aged =30 kg",
    "like +1-234-567-8900 should": "like + should",
    "call 2019 2020 2021 now": "call now",
    "x\n- item\n- two": "x - item - two",
    "a\nb\nc": "a b c",
    "p\n\n\n\n• one\n\n- two": "p one two",
    "ＡＢＣ… ½ ﬁ": "ABC... 1⁄2 fi",
    "Ⅳ ① ²": "IV 1 2",
    "wow?!?! no.... #tag a@b.co": "wow! no...",
    "": "",
}


def test_cleaning_of_crafted_strings(spark):
    got = column(spark, [*CRAFTED, None], lambda c: cleaning.clean(c, unicode=True))
    assert got == [*CRAFTED.values(), ""]


def test_unicode_form_comes_first(spark, small):
    """The chain without the option is held to SQL, so with it the chain must give the same for texts in that form."""
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + ["ﬁne ① Ⅳ\u00a0x…", "e\u0301te\u0301", "ｈｔｔｐｓ://x.y z"]
    formed = column(spark, [unicodedata.normalize("NFKC", x or "") for x in texts], cleaning.clean)
    assert column(spark, texts, lambda c: cleaning.clean(c, unicode=True)) == formed


def test_inert_options_and_default_case():
    assert cleaning.Options().lowercase is False and cleaning.Options.of({}).lowercase is True
    assert cleaning.Options.of({"replace_urls": False, "lowercase": False}).lowercase is False


@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (5, 2), (120, 20)])
def test_chunks(spark, size, overlap):
    texts = ["", None, "one", " ".join(map(str, range(5))), " ".join(map(str, range(12))), " ".join(map(str, range(301)))]
    for text, got in zip(texts, column(spark, texts, lambda c: chunking.chunks(c, size, overlap)), strict=True):
        w = (text or "").split()
        want = [(" ".join(w[i : i + size]), len(w[i : i + size])) for i in range(0, len(w), size - overlap)]
        assert [tuple(x) for x in got] == want
        if not overlap:
            assert " ".join(x.text for x in got).split() == w


def test_chunks_that_never_advance_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        chunking.chunks(None, 50, 50)


WORDS = ["", None, "one", "The cat. The dog! A cat?", "aaa bbb aaa ccc aaa bbb. " * 3, "Éa été, ÉTÉ 123 x_y 'quoted-word'", "... !!! ???"]


def test_word_statistics(spark):
    for text, s in zip(WORDS, column(spark, WORDS, metrics.word_statistics), strict=True):
        w = re.findall(r"\b\w+\b", (text or "").lower())
        c = Counter(w)
        syllables = [max(1, len(re.findall("[aeiouy]+", x))) for x in w]
        assert (s.n, s.syllables, s.poly, s.len_sum) == (len(w), sum(syllables), sum(x >= 3 for x in syllables), sum(map(len, w)))
        assert (s.v, s.v1, s.v2, s.squares) == (len(c), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()), sum(x * x for x in c.values()))
        assert s.clogc == pytest.approx(sum(x * math.log2(x) for x in c.values()))


def test_sentences(spark):
    got = column(spark, WORDS, tokens.n_sentences)
    assert got == [max(1, sum(1 for s in re.split(r"[.!?]+", t or "") if s.strip())) for t in WORDS]


def test_metrics_of_empty_text_are_null_or_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", "")], "document_id string, chunk_text string")
    for r in metrics.metrics_batch(df).collect():
        assert r.flesch is None and r.unique_words is None and r.n_chars == 0 and r.entropy_chars == 0 and r.n_sents == 1
    df = spark.createDataFrame([("a", "!!! ...")], "document_id string, text string")
    r = metrics.metrics_a(df).first()
    assert r.n_tokens == 6 and r.n_chars == 7 and r.n_words == 0 and r.flesch_reading_ease == 0 and r.n_sents == 0


def test_family_a_by_hand(spark):
    text = "The Cat sat. A beautiful cat, 42 cats!"
    df = spark.createDataFrame([("a", text), ("b", "Extraordinarily."), ("c", "42 + 1")], "document_id string, text string")
    a, b, c = metrics.metrics_a(df).orderBy("document_id").collect()
    # words: the cat sat a beautiful cat cats; tokens: those, 42 and . , !; sentences: 3 and 4 words
    assert (a.n_words, a.n_tokens, a.n_sents, a.n_chars, a.n_chars_nospace) == (7, 11, 2, 38, 31)
    assert (a.avg_word_len, a.median_word_len, a.ttr, a.hapax_ratio, a.hapax_dis_ratio) == pytest.approx((26 / 7, 3.0, 6 / 7, 5 / 7, 1 / 7))
    assert (a.prop_uppercase_words, a.prop_punct_tokens, a.prop_stop_tokens, a.lexical_density) == pytest.approx((3 / 7, 3 / 11, 2 / 11, 5 / 7))
    assert (a.avg_sent_len_words, a.std_sent_len_words, a.prop_long_words_7, a.prop_long_words_10, a.lix, a.rix) == pytest.approx((3.5, 0.5, 1 / 7, 0.0, 3.5 + 100 / 7, 0.5))
    assert a.flesch_reading_ease == pytest.approx(206.835 - 1.015 * 3.5 - 84.6 * 9 / 7) and a.gunning_fog == pytest.approx(0.4 * (3.5 + 100 / 7))
    assert (b.n_words, b.median_word_len, b.std_word_len, b.prop_long_words_10, b.log_ttr) == (1, 15.0, 0.0, 1.0, 0.0)
    assert (c.n_words, c.n_sents, c.n_tokens, c.rix, c.noun_ratio) == (0, 0, 3, 0.0, None)


def test_scores(spark):
    rows = [("a", "the the cat", "the cat the"), ("b", "", "x"), ("c", None, None), ("d", "a b c d e f", "a b c d e f"), ("e", "x y y z", "y z q"), ("f", "a b c d e", "a b c d x"), ("g", "a b c d", "a b c d e f"), ("h", "a b c d e", "a b c d")]
    df = spark.createDataFrame(rows, "document_id string, prediction string, reference string")
    got = {r.document_id: r for r in scoring.score_rows(df).collect()}
    for name, pred, ref in rows:
        p, r = (pred or "").lower().split(), (ref or "").lower().split()
        hit = sum(min(x, Counter(r)[t]) for t, x in Counter(p).items())
        assert got[name].rouge_precision == pytest.approx(hit / max(1, len(p)), abs=1e-4)
        assert got[name].recall == pytest.approx(len(set(p) & set(r)) / max(1, len(r)), abs=1e-4)
    # By hand: (4/5 * 3/4 * 2/3 * 1/2) ** (1/4); all n-grams hit, but four words for six: exp(1 - 6/4); no n-gram of some length hits.
    bleus = {"a": 0.0, "b": 0.0, "c": 0.0, "d": 1.0, "e": 0.0, "f": 0.6687, "g": 0.6065, "h": 0.6687}
    assert {k: r.bleu for k, r in got.items()} == pytest.approx(bleus, abs=1e-4)
    assert got["d"].rouge_f1 == 1.0
    with pytest.raises(ValueError, match="reference"):
        scoring.score_rows(df.drop("reference"))
    many = spark.range(100).repartition(3).select(F.lit("a").alias("prediction"), F.lit("a").alias("reference"))
    assert sorted(r.document_id for r in scoring.score_rows(many).collect()) == sorted(f"row_{i}" for i in range(100))


def test_generation_helpers(spark):
    df = spark.createDataFrame([("in", "in out", [1, 2, 3])], "t string, g string, ids array<int>")
    r = df.select(
        generation.drop_echo(F.col("g"), F.col("t")).alias("echo"),
        generation.drop_echo(F.col("t"), F.col("t")).alias("all"),
        generation.extract_answer(generation.prompt(F.col("t"), F.col("g"))).alias("answer"),
        generation.mask_labels(F.col("ids"), 5, 0, F.lit(1)).alias("mask"),
        generation.reward(F.lit(1.0), F.lit(0.5), F.lit(150.0), (0.4, 0.4, 0.2)).alias("reward"),
        generation.guarded(F.lit(0.9), F.col("t")).alias("guard"),
    ).first()
    assert (r.echo, r["all"], r.answer, r["mask"], r.guard) == ("out", "in", "in out", [-100, 2, 3, -100, -100], 0.0)
    assert r.reward == pytest.approx(0.8)


def test_labels(spark):
    df = spark.createDataFrame([("pls/Trial Summaries/1-a_b.txt",), ("x/no_pls.md",), ("plain.txt",)], "p string")
    r = df.select(labels.source_of(F.col("p"), "pls").alias("s"), labels.stem(F.col("p")).alias("n"), labels.label_of(F.col("p"), ["PLS"], ["plain"]).alias("l")).collect()
    assert [tuple(x) for x in r] == [("Trial Summaries", "1-a_b", "PLS"), ("x", "no_pls", "PLS"), ("unknown", "plain", "NO_PLS")]
    assert labels.output_name("/a/b/c.parquet") == "/a/b/c_metrics.parquet" and labels.output_name("c.parquet", "o") == "o/c_metrics.parquet"
    ids = spark.createDataFrame([("12-abstract_x",), ("7-pls",), (None,)], "i string").select(labels.normalize_doc_id(F.col("i")).alias("x")).collect()
    assert [x.x for x in ids] == ["12", "7", None]


def test_pair_scores_equal_the_column_functions(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c D é".split()) for _ in range(rng.randrange(12))) for _ in range(60)] + ["", None, " a b c ", "x\x1cy x"]
    rows = [(str(i), rng.choice(texts), rng.choice(texts)) for i in range(200)]
    df = spark.createDataFrame(rows, "document_id string, prediction string, reference string")
    arrays = df.select("document_id", scoring.score_tokens(F.col("prediction")).alias("p"), scoring.score_tokens(F.col("reference")).alias("r"))
    p, r = F.col("p"), F.col("r")
    want = {x.document_id: x for x in arrays.select("document_id", scoring.rouge_1(p, r).alias("rouge"), scoring.token_f1(p, r).alias("token"), scoring.bleu(p, r).alias("bleu")).collect()}
    for x in scoring.score_rows(df, 9).collect():
        w = want[x.document_id]
        assert [x.rouge_precision, x.rouge_recall, x.rouge_f1, x.bleu, x.precision, x.recall, x.f1] == pytest.approx([*w.rouge, w.bleu, *w.token], abs=1e-8)
