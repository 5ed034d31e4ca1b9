"""Stochastic logistic regression against a replay in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import ml, sgd
from textloom.plans import queries


def replay(rows, features, classes, settings):
    """Plain gradient steps over (shard, side, h, y, indices, values) rows, no common factor: coefficients and history."""
    shards = {}
    for shard, side, h, y, indices, values in rows:
        x = np.zeros(features)
        x[list(indices)] = values
        shards.setdefault(shard, {"train": [], "test": []})[side].append((h, x, y))
    k = 1 if classes == 2 else classes
    w, b, history = np.zeros((k, features)), np.zeros(k), []

    def p_of(x):
        p = 1 / (1 + np.exp(-(w @ x + b)))
        return np.array([1 - p[0], p[0]]) if k == 1 else p / p.sum()

    for epoch in range(settings.epochs):
        parts = []
        for shard, sides in sorted(shards.items()):
            u, v = w.copy(), b.copy()
            train = [r[1:] for r in sorted(sides["train"], key=lambda r: r[0])]
            for number, at in enumerate(range(0, len(train), settings.batch)):
                part = train[at : at + settings.batch]
                for i in np.random.default_rng([settings.seed, epoch, shard, number]).permutation(len(part)):
                    x, y = part[i]
                    t = np.array([y == 1]) if k == 1 else np.arange(k) == y
                    g = 1 / (1 + np.exp(-(u @ x + v))) - t
                    u = u * (1 - settings.rate * settings.reg) - settings.rate * np.outer(g, x)
                    v = v - settings.rate * 0.01 * g
            parts.append((len(train), u, v))
        n = sum(p[0] for p in parts)
        w, b = sum(p[0] * p[1] for p in parts) / n, sum(p[0] * p[2] for p in parts) / n
        entry = {"epoch": epoch + 1}
        for name, side in (("train", "train"), ("val", "test")):
            seen = [(y, p_of(x)) for s in shards.values() for _, x, y in s[side]]
            entry[f"{name}_log_loss"] = -sum(math.log(p[y]) for y, p in seen) / len(seen)
            entry[f"{name}_accuracy"] = sum(p.argmax() == y for y, p in seen) / len(seen)
            f1 = 0
            for c in range(classes):
                hit = sum(y == c and p.argmax() == c for y, p in seen)
                either = sum(y == c for y, _ in seen) + sum(p.argmax() == c for _, p in seen)
                f1 += (2 * hit / either if either else 0) * sum(y == c for y, _ in seen)
            entry[f"{name}_f1"] = f1 / len(seen)
        history.append(entry)
    return w, b, history


def table(spark, n, classes, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.integers(classes))
        indices = sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist())
        rows.append((str(i), "test" if i % 5 == 0 else "train", y, indices, [float(rng.normal(y if j % classes == y else 0, 1)) for j in indices]))
    rows += rows[3:4] * 40  # a hot row
    return spark.createDataFrame(rows, "id string, side string, y int, indices array<int>, values array<double>")


@pytest.mark.parametrize(("classes", "shard_rows", "batch"), [(2, 10**6, 16), (2, 60, 7), (3, 50, 10), (2, 5, 128)])
def test_history_equals_replay(spark, classes, shard_rows, batch):
    settings = sgd.Settings(epochs=3, rate=0.1, reg=0.01, batch=batch, seed=7, shard_rows=shard_rows)
    rows = table(spark, 300, classes, 1)
    placed = [tuple(r) for r in sgd.dealt(rows, settings, rows.count()).collect()]
    assert len(placed) == 340 and len({r[2] for r in placed}) == 340  # copies have an order of their own
    if shard_rows < 100:
        assert len({r[0] for r in placed}) > 3
    w, b, history = replay(placed, 12, classes, settings)
    model, got = sgd.fit(rows, 12, classes, settings)
    assert len(got) == 3
    for a, e in zip(got, history, strict=True):
        assert a == pytest.approx(e)
    u, v = model.arrays()
    assert u == pytest.approx(w) and v == pytest.approx(b)


def test_model_predicts_and_is_saved(spark, tmp_path):
    model = sgd.SgdModel(coefficients=[1.0, -2.0, 0.0], intercepts=[0.5])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = sgd.SgdModel.load(str(tmp_path / "m"))
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([1.0, 1.0, 9.0]),), (Vectors.sparse(3, [0], [2.0]),), (Vectors.sparse(3, [], []),)], ["features"])
    got = [(r.prediction, r.probability.toArray()[1]) for r in again.transform(df).collect()]
    want = [1 / (1 + math.exp(-z)) for z in (-0.5, 2.5, 0.5)]
    assert [g[1] for g in got] == pytest.approx(want) and [g[0] for g in got] == [0.0, 1.0, 1.0]


def test_odd_tables(spark):
    rows = table(spark, 20, 2, 3)
    with pytest.raises(ValueError, match="two classes"):
        sgd.fit(rows, 12, 1)
    with pytest.raises(ValueError, match="learn"):
        sgd.fit(rows.where("side = 'test'"), 12, 2)
    _, history = sgd.fit(rows.where("side = 'train'"), 12, 2, sgd.Settings(epochs=1))
    assert math.isnan(history[0]["val_accuracy"]) and not math.isnan(history[0]["train_accuracy"])


def test_query_learns(spark, small):
    got = queries.queries()["q65_tfidf_classifier"](spark, small).orderBy("epoch").collect()
    assert [r.epoch for r in got] == [1.0, 2.0, 3.0]
    assert got[0].train_log_loss > got[1].train_log_loss > got[2].train_log_loss


def test_training_job_equals_replay(spark):
    texts = [("pls" if i % 2 else "no_pls", f"{'plain easy' if i % 2 else 'technical dosage'} words number{i % 7}") for i in range(60)]
    df = spark.createDataFrame(texts, "label string, chunk_text string")
    model, held, history = ml.training_job(df, epochs=2, rate=0.5, batch=8)
    rows = ml.stratified_split(df.withColumn("__id", F.sha2(F.concat_ws("\x1f", "label", "chunk_text"), 256)), ["label"], "__id", 0.2, 13)
    rows = ml.PipelineModel(model.stages[:-1]).transform(rows.withColumn("__terms", ml.term_array(F.col("chunk_text"))))
    x = rows.select(F.col("__id").alias("id"), F.col("split").alias("side"), F.expr("int(label = 'pls')").alias("y"), sgd.sparse(F.col("features")).alias("x")).select("id", "side", "y", "x.*")
    settings = sgd.Settings(2, 0.5, 1e-4, 8, 13)
    _, _, want = replay([tuple(r) for r in sgd.dealt(x, settings, 60).collect()], len(model.stages[0].vocabulary), 2, settings)
    assert [pytest.approx(w) for w in want] == history
    assert held.count() == 12
