"""Overlap scores between a prediction and a reference, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import kernels
from textloom.functions.let import let, ratio
from textloom.functions.metrics import run_lengths
from textloom.functions.tokens import ngrams, white_words
from textloom.schemas import require_columns

_OVERLAPS, _LIGHT = kernels.overlap_counts(4), kernels.light_counts()


def score_tokens(text: Column) -> Column:
    return white_words(F.lower(F.coalesce(text, F.lit(""))))


def _numbered(tokens: Column) -> Column:
    """The items of an array, each made unique by its number among its copies; in linear time after a sort."""

    def of(s: Column) -> Column:
        runs = F.zip_with(F.array_distinct(s), run_lengths(s), lambda t, c: F.transform(F.sequence(F.lit(1), c), lambda k: F.concat(t, F.lit("\x1e"), k.cast("string"))))
        return F.flatten(runs)

    return let(F.array_sort(tokens), of)


def clipped_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b))).cast("bigint")


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)


def rouge_1(pred: Column, ref: Column) -> Column:
    """Struct of precision, recall and f1 of clipped unigrams."""

    def of(overlap: Column) -> Column:
        p, r = ratio(overlap, F.size(pred)), ratio(overlap, F.size(ref))
        return F.struct(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))

    return let(clipped_overlap(pred, ref), of)


def token_f1(pred: Column, ref: Column) -> Column:
    """Struct of precision, recall and f1: shared types over all tokens of a side."""

    def of(overlap: Column) -> Column:
        p, r = ratio(overlap, F.size(pred)), ratio(overlap, F.size(ref))
        return F.struct(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))

    return let(F.size(F.array_intersect(pred, ref)), of)


def bleu(pred: Column, ref: Column, max_n: int = 4) -> Column:
    """BLEU with clipped n-grams, smoothed by 1e-9, with a brevity penalty unless the prediction is longer."""
    total = F.lit(0.0)
    for n in range(1, max_n + 1):
        grams = let(F.struct(ngrams(pred, n).alias("p"), ngrams(ref, n).alias("r")), lambda g: ratio(clipped_overlap(g["p"], g["r"]), F.size(g["p"])))
        total = total + F.log(grams + 1e-9) / max_n
    brevity = F.when(F.size(pred) > F.size(ref), 1.0).otherwise(F.exp(1 - ratio(F.size(ref), F.greatest(F.size(pred), F.lit(1)))))
    return F.when((F.size(pred) > 0) & (F.size(ref) > 0), brevity * F.exp(total)).otherwise(0.0)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that numbers its rows 0, 1, ... in the order of its partitions.

    Rows are counted by partition first; there is one offset a partition to broadcast.
    """
    held = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    joined = held.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__offset") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__offset")


def score_rows(df: DataFrame, digits: int = 4) -> DataFrame:
    """document_id and seven scores, rounded; the id defaults to ``row_0``, ``row_1``, ... in input order."""
    require_columns(df, ("prediction", "reference"))
    if "document_id" not in df.columns:
        df = numbered(df.select("prediction", "reference"), "__row").withColumn("document_id", F.concat(F.lit("row_"), F.col("__row").cast("string")))
    low = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("prediction", "reference")]
    held = df.select(F.col("document_id").cast("string").alias("document_id"), _OVERLAPS(*low).alias("c"))
    return held.select("document_id", *(F.round(x, digits).alias(k) for k, x in pair_scores(F.col("c")).items()))


def pair_scores(c: Column) -> dict[str, Column]:
    """ROUGE-1, BLEU-4 and token scores from the counts of ``kernels.overlap_counts(4)``, as ``rouge_1``, ``bleu`` and ``token_f1`` have them."""
    sides = {"precision": "p", "recall": "r"}
    rouge, token = ({k: ratio(c[hits], c[n]) for k, n in sides.items()} for hits in ("hit_1", "types"))
    grams = sum((F.log(ratio(c[f"hit_{n}"], c[f"all_{n}"]) + 1e-9) / 4 for n in range(1, 5)), F.lit(0.0))
    brevity = F.when(c["p"] > c["r"], 1.0).otherwise(F.exp(1 - ratio(c["r"], F.greatest(c["p"], F.lit(1)))))
    score = F.when((c["p"] > 0) & (c["r"] > 0), brevity * F.exp(grams)).otherwise(0.0)
    first = {f"rouge_{k}": x for k, x in (rouge | {"f1": f1(rouge["precision"], rouge["recall"])}).items()}
    return first | {"bleu": score} | token | {"f1": f1(token["precision"], token["recall"])}


def light_stats(text: Column) -> Column:
    """Struct of tokens, chars, unique, avg_word_len and avg_sent_len (rounded to 2)."""
    c = _LIGHT(text)
    n, sents = c["tokens"], c["sents"]
    return F.struct(
        n.alias("tokens"), c["chars"].alias("chars"), c["unique"].alias("unique"),
        F.round(ratio(c["solid"], n), 2).alias("avg_word_len"), F.round(F.when(sents > 0, ratio(n, sents)).otherwise(n.cast("double")), 2).alias("avg_sent_len"),
    )


def summarize(original: Column, processed: Column) -> Column:
    """Struct of both texts' stats, delta_tokens and token_reduction_pct; each text is read once."""
    o, p = light_stats(original), light_stats(processed)
    cut = F.when(o["tokens"] > 0, (1 - ratio(p["tokens"], o["tokens"])) * 100).otherwise(0.0)
    return F.struct(o.alias("original"), p.alias("processed"), (p["tokens"] - o["tokens"]).alias("delta_tokens"), F.round(cut, 2).alias("token_reduction_pct"))
