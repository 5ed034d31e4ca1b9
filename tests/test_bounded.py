"""What a Python worker holds at once, and how often a text is read."""

import pickle
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import session
from textloom.functions import cleaning, kernels, remember, scoring, tokenizer
from textloom.operators import describe, ml, sentences, sgd

LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "67108864"}


@pytest.fixture
def wide(spark):
    """Spark's own batch limits, whatever ran before."""
    for key, value in LIMITS.items():
        spark.conf.set(key, value)
    return spark


def limits(spark):
    return [int(spark.conf.get(k)) for k in LIMITS]


def test_a_kernel_holds_a_megabyte_or_so(wide):
    texts = wide.range(0, 400, 1, 1).select(F.repeat(F.lit("some words "), 2000).alias("text"))
    size = kernels._kernel(lambda t: pa.array([t.nbytes] * len(t), pa.int64()), T.LongType())
    assert texts.select(size(F.col("text")).alias("n")).agg(F.max("n")).first()[0] < 3 << 20


@pytest.mark.parametrize("of", [
    lambda s, df: ml.tfidf(df, "doc_id", "text"),
    lambda s, df: sentences.learn(df),
    lambda s, df: df.select(sentences.sentences(sentences.Model(frozenset(), frozenset()))(F.col("text"))),
    lambda s, df: df.select(kernels.word_counts(frozenset())(F.col("text"))),
    lambda s, df: sgd.fit(df.select(F.col("doc_id").alias("id"), F.lit("train").alias("side"), (F.col("doc_id") % 2).cast("int").alias("y"), F.array(F.lit(0)).alias("indices"), F.array(F.lit(1.0)).alias("values")), 1, 2, sgd.Settings(1)),
])
def test_batches_are_small_where_texts_are_counted(wide, of):
    of(wide, wide.createDataFrame([(k, "One two. Two three!") for k in range(4)], "doc_id bigint, text string"))
    rows, size = limits(wide)
    assert rows <= 1000 and size <= 1 << 20


def test_smaller_limits_stay(wide):
    wide.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    wide.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "3k")
    session.small_batches()
    assert [wide.conf.get(k) for k in LIMITS] == ["7", "3k"]


def test_terms_are_added_up_over_several_flushes(spark, monkeypatch):
    monkeypatch.setattr(kernels, "HELD", 2)
    texts = pa.RecordBatch.from_arrays([pa.array(["aa bb aa", None, "bb cc", "aa bb"])], ["t"])
    sums = {}
    for batch in kernels.term_totals(2)(iter([texts])):
        for term, df, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = sums.get(term, (0, 0))
            sums[term] = (a + df, b + total)
    assert sums == {"aa": (2, 3), "bb": (3, 3), "cc": (1, 1), "aa bb": (2, 2), "bb aa": (1, 1), "bb cc": (1, 1)}


def test_no_document_is_shuffled_for_tfidf(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa bb")], "doc_id bigint, text string")
    assert "Exchange" not in ml.tfidf(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_cleaned_once_for_its_stats(spark):
    df = spark.createDataFrame([("a b",)], "text string").select(scoring.summarize(F.col("text"), cleaning.clean(F.col("text"))).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("•") == 1


def test_box_statistics_read_written_values(spark):
    df = spark.createDataFrame([("x", "a b"), ("y", "c")], "label string, text string")
    counted = df.select("label", kernels.word_counts(frozenset())(F.col("text"))["n"].alias("n"))
    assert "ArrowEvalPython" not in describe.box_statistics(counted, "label", ["n"])._jdf.queryExecution().executedPlan().toString()


def test_counts_of_chunks_equal_counts_of_tokens():
    text = "Dr. Smith's dog-house (5km) isn't, e.g., here... see www.a.org/x. Dr. No! no dog-house"
    own = pickle.loads(pickle.dumps(tokenizer.Tokenizer()))
    assert own.counts(text) == Counter(own(text))
    assert own.n_words(text) == sum(map(str.isalpha, own(text)))


def test_spans_equal_the_rule_for_each_word():
    model = pickle.loads(pickle.dumps(sentences.Model(frozenset({"dr", "e.g"}), frozenset({"then"}))))
    text = ' "Dr. Who?" said 5. then 6. Then Dr. Then A. B. left... Now left... now, e.g. this.   End'
    out, begin, last = [], None, None
    for word in sentences.words(text):
        if last is not None and model.ends(last, word):
            out.append((begin, last.end))
            begin = None
        begin = word.start if begin is None else begin
        last = word
    assert model.spans(text) == [*out, (begin, last.end)] and model.spans(" \n") == []


def test_short_ways_equal_the_rules():
    own, rules = tokenizer.Tokenizer(), tokenizer.Tokenizer()
    for chunk in ("word", "word.", "Word,", "A.", "US.", "cannot", "cannot,", "don't.", "5km.", "dr.", "Dr.,", "a", "É.", "maß…", "www.a.org.", "x@y.org,"):
        front, back, rest = [], [], chunk
        while rest:  # the rules, one sign at a time, without the short ways
            parts = rules.exceptions.get(rest.lower())
            if parts:
                ends = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
                front += [rest[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            elif tokenizer.URL.fullmatch(rest) or len(rest) == 1:
                front.append(rest)
            elif rest[0] in tokenizer.PREFIXES:
                front.append(rest[0])
                rest = rest[1:]
                continue
            elif size := rules._suffix(rest):
                back.append(rest[-size:])
                rest = rest[:-size]
                continue
            else:
                front += rules._infixes(rest)
            break
        assert own(chunk) == front + back[::-1], chunk


def test_long_keys_are_not_all_remembered(monkeypatch):
    monkeypatch.setattr(remember, "CHARACTERS", 100)
    held = remember.Remembered(len)
    for k in range(50):
        assert [held[key] for key in (f"{k:02}" * 20, f"{k:02}")] == [40, 2]
        assert sum(map(len, held)) <= 100
    assert held["x" * 1000] == 1000 and list(held) == ["x" * 1000]


def test_long_words_are_counted_over_several_flushes(spark, monkeypatch):
    monkeypatch.setattr(sentences, "CHARACTERS", 100)
    df = spark.createDataFrame([(f"{'x' * 90}{k % 3}. end",) for k in range(12)], "text string").coalesce(1)
    sent = []
    monkeypatch.setattr(type(df.groupBy()), "agg", lambda grouped, *columns: sent.append(grouped._df) or None)
    sentences.word_counts(df, "text")
    assert sent[0].count() > 4
    monkeypatch.undo()
    assert {tuple(r) for r in sentences.word_counts(df, "text").collect()} == {("end", 0, 12), *((f"{'x' * 90}{k}", 4, 0) for k in range(3))}
