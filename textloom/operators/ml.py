"""Features and classifiers on MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import kernels
from textloom.functions.let import let
from textloom.functions.tokens import ngrams
from textloom.operators import sgd
from textloom.operators.sampling import stratified_split
from textloom.session import small_batches

#: Words of two or more letters, digits or ``_``.
TERM = r"(?U)\b\w\w+\b"


def term_array(text: Column, max_n: int = 2) -> Column:
    """The n-grams of 1..max_n of a text's words, repeats included."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), 0)
    grams = lambda w: [F.transform(ngrams(w, n), lambda g: F.replace(g, F.lit("\x1f"), F.lit(" "))) for n in range(2, max_n + 1)]
    return let(words, lambda w: F.concat(w, *grams(w)))


def vocabulary(df: DataFrame, text: str, max_n: int = 2, max_features: int = 6000, min_df: int = 2) -> DataFrame:
    """(term, df, idf) of the most frequent terms with enough documents; idf is ln((1 + n) / (1 + df)) + 1.

    Terms are added up within tasks before they are shuffled.
    """
    n_docs = df.count()
    small_batches(df.sparkSession)
    totals = df.select(F.lower(F.col(text))).mapInArrow(kernels.term_totals(max_n), "term string, df bigint, total bigint")
    counted = totals.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(F.col("df") >= min_df)
    top = counted.orderBy(F.desc("total"), "term").limit(max_features)
    return top.select("term", "df", (F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, doc: str, text: str, max_n: int = 2, max_features: int = 6000, min_df: int = 2) -> DataFrame:
    """(doc, term, weight): L2-normalised tf-idf over the kept vocabulary, which is bounded by ``max_features``; ids are unique.

    Terms are counted within tasks and weighed within the row, so no document is shuffled.
    """
    idf = {r.term: r.idf for r in vocabulary(df, text, max_n, max_features, min_df).collect()}  # max_features at most
    weights = kernels.term_weights(max_n, idf)(F.lower(F.coalesce(text, F.lit(""))))
    return df.select(doc, weights.alias("x")).select(doc, F.explode("x").alias("x")).select(doc, "x.term", "x.weight")


def fit_tfidf(train: DataFrame, text: str, terms: str = "__terms", out: str = "features", max_n: int = 2, max_features: int = 6000, min_df: int = 2) -> PipelineModel:
    """L2-normalised tf-idf vectors of a ``term_array`` column, with the vocabulary and idf of the training rows alone."""
    rows = vocabulary(train, text, max_n, max_features, min_df).orderBy("term").collect()  # max_features at most
    if not rows:
        raise ValueError("no term is in enough documents")
    tf = CountVectorizerModel.from_vocabulary([r.term for r in rows], inputCol=terms, outputCol=f"{out}_tf")
    weigh = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in rows]), inputCol=f"{out}_tf", outputCol=f"{out}_idf")
    return PipelineModel([tf, weigh, Normalizer(p=2.0, inputCol=f"{out}_idf", outputCol=out)])


def label_index(df: DataFrame, label: str, out: str = "y") -> tuple[DataFrame, list[str]]:
    """Labels as numbers in alphabetical order."""
    model = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df), list(model.labels)


def evaluate(predictions: DataFrame, label: str = "y") -> dict[str, float]:
    measure = lambda m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(predictions)
    return {"accuracy": measure("accuracy"), "f1": measure("f1"), "log_loss": measure("logLoss")}


def fit_logistic(df: DataFrame, features: str = "features", label: str = "y", epochs: int = 1000, reg: float = 0.0) -> PipelineModel:
    return Pipeline(stages=[LogisticRegression(featuresCol=features, labelCol=label, maxIter=epochs, regParam=reg)]).fit(df)


def training_job(
    df: DataFrame, text: str = "chunk_text", label: str = "label", epochs: int = 5, reg: float = 1e-4, test: float = 0.2, seed: int = 13, rate: float = 0.001, batch: int = 128
) -> tuple[PipelineModel, DataFrame, list[dict]]:
    """TF-IDF and stochastic logistic regression: (model over a ``__terms`` column, validation predictions, history by epoch).

    All rows count, repeated ones as often as they occur. Vocabulary, idf and
    coefficients come from the training rows only; every epoch is one pass.
    """
    rows = df.where(F.trim(text) != "").withColumn("__id", F.sha2(F.concat_ws("\x1f", F.col(label), F.col(text)), 256))
    split, names = label_index(stratified_split(rows, [label], "__id", test, seed).withColumn("__terms", term_array(F.col(text))), label)
    split = split.persist(StorageLevel.DISK_ONLY)
    features = fit_tfidf(split.where("split = 'train'"), text)
    x = sgd.sparse(F.col("features"))
    vectors = features.transform(split).select(F.col("__id").alias("id"), F.col("split").alias("side"), F.col("y").cast("int").alias("y"), x.alias("x")).select("id", "side", "y", "x.*")
    model, history = sgd.fit(vectors, len(features.stages[0].vocabulary), len(names), sgd.Settings(epochs, rate, reg, batch, seed))
    split.unpersist()
    whole = PipelineModel([*features.stages, model])
    out = whole.transform(split.where("split = 'test'")).select("__id", text, label, "y", "prediction", vector_to_array("probability").alias("probability"))
    return whole, out, history


def embedding_features(df: DataFrame, vector: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def classify(df: DataFrame, vector: str, model: PipelineModel, names: dict[int, str] | None = None) -> DataFrame:
    """``df`` with predicted label and probability, from an embedding column (normalise it first if the model asks for it)."""
    done = model.transform(embedding_features(df, vector))
    p = F.array_max(vector_to_array("probability"))
    code = F.col("prediction").cast("int")
    label = F.coalesce(*(F.when(code == k, v) for k, v in (names or {0: "no_pls", 1: "pls"}).items()))
    return done.select(*df.columns, label.alias("predicted"), p.alias("probability"))


def classify_texts(df: DataFrame, text: str, model: PipelineModel, names: Sequence[str] = ("no_pls", "pls")) -> DataFrame:
    """``df`` with predicted label and probability, by a model of ``training_job``; ``names`` are the labels in alphabetical order."""
    done = model.transform(df.withColumn("__terms", term_array(F.col(text))))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1)
    return done.select(*df.columns, label.alias("predicted"), F.array_max(vector_to_array("probability")).alias("probability"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
