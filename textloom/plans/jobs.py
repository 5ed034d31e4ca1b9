"""The metrics, distribution and evaluation jobs, and their command line."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import session
from textloom.functions import generation as gen
from textloom.functions.labels import normalize_doc_id, output_name
from textloom.functions.metrics import metrics_a, metrics_batch
from textloom.functions.scoring import score_rows
from textloom.operators import calls, describe, evaluate, ml, pairing, plugins, sampling, telemetry
from textloom.plans import corpus
from textloom.schemas import numeric_columns, require_columns
from textloom.sources import tables

#: The columns that plots leave out, and the tables that pairs are built from.
NOT_METRICS = ("doc_id", "unit_id", "label", "source", "split", "s3_key")
PAIR_TABLES = ("main_train.parquet", "main_test.parquet", "augmented_train.parquet", "augmented_test.parquet", "no_pls_clean.parquet", "pls_clean.parquet")


def metrics_job(spark: SparkSession, inputs: Sequence[str], out: str | None = None, family: str = "a", text: str = "text", report: telemetry.Report = telemetry.say) -> list[str]:
    """Write ``<stem>_metrics.parquet`` for each input, reporting progress; a projection, so nothing is shuffled."""
    written = []
    for path in inputs:
        df = require_columns(spark.read.parquet(path), [text])
        result = metrics_a(df, text) if family == "a" else metrics_batch(df, text)
        target = output_name(path, out)
        with telemetry.Watch(spark, path.rstrip("/").rsplit("/", 1)[-1], rows=telemetry.rows_of(spark, target), report=report):
            result.write.mode("overwrite").parquet(target)
        written.append(target)
    return written


def distributions(df: DataFrame, metrics: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """Density histograms by label of the given metrics, or of all numeric columns."""
    require_columns(df, ["label"])
    return describe.histogram(df.where(F.col("label").isNotNull()), "label", list(metrics or numeric_columns(df, NOT_METRICS)), bins)


def load_pairs(spark: SparkSession, folder: str, seed: int = 42) -> DataFrame:
    """Technical and plain pairs of the corpus tables, with their 70/15/15 split."""
    docs = tables.read_parquets(spark, folder, PAIR_TABLES).withColumn("norm", normalize_doc_id(F.col("doc_id")))
    found = pairing.pairs(docs, "norm").select("medical", "plain", F.lit(None).cast("string").alias("context"), "pair_id", F.lit(None).cast("double").alias("flesch_score"))
    return sampling.three_way_split(found, "pair_id", seed=seed)


def evaluate_generator(pairs: DataFrame, factory: Callable, limit: int = 30, seed: int = 42) -> DataFrame:
    """Generate for a sample of pairs and score what came back; rows in error have null scores."""
    sample = sampling.shuffled_sample(pairs, "pair_id", limit, seed).withColumn("prompt", gen.prompt(F.col("medical")))
    made = plugins.generate(sample, "prompt", factory)
    answer = gen.extract_answer(F.col("generated"))
    valid = made.withColumn("answer", answer).withColumn("valid", F.coalesce(gen.valid_generation(F.col("answer")), F.lit(False))).persist()
    scores = score_rows(valid.where("valid").select(F.col("pair_id").alias("document_id"), F.col("answer").alias("prediction"), F.col("plain").alias("reference")))
    return valid.join(scores.withColumnRenamed("document_id", "pair_id"), "pair_id", "left")


def compare(results: dict[str, DataFrame], metrics: Sequence[str], base: str) -> DataFrame:
    """A metric by system table with differences to ``base``."""
    names = list(results)
    rows = None
    for name, df in results.items():
        one = df.select(F.lit(name).alias("model"), *metrics)
        rows = one if rows is None else rows.unionByName(one)
    return evaluate.pivot_delta(evaluate.system_means(rows, "model", metrics), "model", metrics, names, base)


def generator(name: str, options: Sequence[str]) -> Callable[[], Callable[[str], str]]:
    """The factory that ``module:factory`` names, bound to its ``name=value`` options."""
    module, _, attribute = name.partition(":")
    values = dict(o.split("=", 1) for o in options)

    def make() -> Callable[[str], str]:
        return getattr(importlib.import_module(module), attribute)(**values)

    return make


def infer_job(spark: SparkSession, args: argparse.Namespace) -> None:
    """Answers of a table, committed batch by batch below ``--out``; or, of one text, printed."""
    make = generator(args.generator, args.option)
    if not args.input:
        if not (args.text or args.file):
            raise SystemExit("give --text, --file or --input")
        one = args.text
        if not one:
            with open(args.file, encoding="utf-8") as file:
                one = file.read()
        rows = spark.createDataFrame([(one,)], "text string").select(gen.prompt(F.col("text")).alias("prompt"))
        asked = plugins.generate(rows, "prompt", make, args.tries).select(gen.extract_answer(F.col("generated")).alias("answer"), "error").first()
        print(asked.answer if asked.error is None else asked.error)
        return
    df = require_columns(spark.read.parquet(args.input), [args.key_col, args.text_col])
    requests = df.select(F.col(args.key_col).alias("key"), gen.prompt(F.coalesce(F.col(args.text_col), F.lit(""))).alias("prompt"))
    done = calls.answer(requests, f"{args.out.rstrip('/')}/calls", make, limits=calls.Limits(tries=args.tries, per_second=args.per_second), retry_dead=args.retry_dead)
    shown = done.select("key", gen.extract_answer(F.col("answer")).alias("answer"), "error", "tries")
    out = f"{args.out.rstrip('/')}/answers"
    with telemetry.Watch(spark, "infer", rows=telemetry.rows_of(spark, out)):
        shown.write.mode("overwrite").parquet(out)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textloom")
    jobs = parser.add_subparsers(dest="job", required=True)
    build = jobs.add_parser("corpus", help="build the corpus from a text tree")
    build.add_argument("--root", required=True)
    build.add_argument("--out", required=True)
    measure = jobs.add_parser("metrics", help="compute text metrics of Parquet tables")
    measure.add_argument("--input", nargs="+", required=True)
    measure.add_argument("--output-dir")
    measure.add_argument("--family", choices=("a", "b"), default="a")
    measure.add_argument("--text-col", default="text")
    plot = jobs.add_parser("distributions", help="density histograms by label")
    plot.add_argument("--input", required=True)
    plot.add_argument("--out", required=True)
    plot.add_argument("--metrics", nargs="*")
    plot.add_argument("--bins", type=int, default=50)
    score = jobs.add_parser("score", help="score a CSV of prediction and reference")
    score.add_argument("--input", required=True)
    score.add_argument("--out", required=True)
    infer = jobs.add_parser("infer", help="generate simplified texts with a plug-in, resumably")
    infer.add_argument("--generator", required=True, help="module:factory; the factory takes the options and returns a callable over prompts")
    infer.add_argument("--option", nargs="*", default=[], help="name=value pairs for the factory, such as temperature=0.7")
    infer.add_argument("--text")
    infer.add_argument("--file")
    infer.add_argument("--input", help="a Parquet table")
    infer.add_argument("--out", help="folder of the answers of a table")
    infer.add_argument("--key-col", default="doc_id")
    infer.add_argument("--text-col", default="text")
    infer.add_argument("--tries", type=int, default=3)
    infer.add_argument("--per-second", type=float)
    infer.add_argument("--retry-dead", action="store_true")
    label = jobs.add_parser("classify", help="label a table of embeddings, or of texts, with a saved model")
    label.add_argument("--input", required=True)
    label.add_argument("--model", required=True)
    label.add_argument("--out", required=True)
    label.add_argument("--vector-col", help="embeddings; without it the model is one of the training job, over texts")
    label.add_argument("--text-col", default="chunk_text")
    args = parser.parse_args(argv)
    spark = session.build()
    if args.job == "corpus":
        corpus.run(spark, args.root, args.out)
    elif args.job == "metrics":
        metrics_job(spark, args.input, args.output_dir, args.family, args.text_col)
    elif args.job == "distributions":
        distributions(spark.read.parquet(args.input), args.metrics, args.bins).write.mode("overwrite").parquet(args.out)
    elif args.job == "infer":
        infer_job(spark, args)
    elif args.job == "classify":
        df, model = spark.read.parquet(args.input), ml.load(args.model)
        done = ml.classify(df, args.vector_col, model) if args.vector_col else ml.classify_texts(df, args.text_col, model)
        with telemetry.Watch(spark, "classify", rows=telemetry.rows_of(spark, args.out)):
            done.write.mode("overwrite").parquet(args.out)
    else:
        score_rows(tables.read_csv(spark, args.input, None)).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
