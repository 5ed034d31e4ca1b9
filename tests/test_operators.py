"""Sampling, pairing, sources, sinks, jobs and plug-ins."""

import json
import math
import threading
import zipfile
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions import cleaning
from textloom.operators import describe, evaluate, ml, pairing, plugins, sampling
from textloom.plans import corpus, jobs
from textloom.sources import listing, sinks, tables, text


@pytest.mark.parametrize(("n", "want"), [(1, 0), (2, 1), (4, 1), (5, 1), (9, 1), (10, 2), (1000, 200)])
def test_stratified_split_sizes(spark, n, want):
    df = spark.range(n).select(F.col("id"), F.lit("a").alias("g"))
    out = sampling.stratified_split(df, ["g"], "id").collect()
    assert len(out) == n and sum(r.split == "test" for r in out) == want


def test_caps_and_splits_cover_every_row(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    capped = sampling.cap_groups(df, ["g"], 100, "id")
    assert {r["count"] for r in capped.groupBy("g").count().collect()} == {100}
    assert sorted(r.id for r in sampling.cap_groups(df, ["g"], 100, "id").collect()) == sorted(r.id for r in capped.collect())
    split = {r.split: r["count"] for r in sampling.three_way_split(df, "id").groupBy("split").count().collect()}
    assert split == {"train": 2100, "validation": 450, "test": 450}


def test_dedup_keeps_first_and_nulls(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "id int, t string")
    assert sorted(r.id for r in sampling.drop_duplicates(df, ["t"], ["id"]).collect()) == [1, 2]


def test_pairs(spark):
    rows = [("1_a", "xx", "no_pls"), ("1_b", "xxx", "no_pls"), ("1-pls", "p", "pls"), ("2", "only", "pls")]
    df = spark.createDataFrame(rows, "doc_id string, text string, label string").withColumn("norm", F.regexp_replace(F.substring_index("doc_id", "_", 1), "-pls", ""))
    assert [tuple(r) for r in pairing.pairs(df, "norm").collect()] == [("1", "xxx", "p")]
    files = spark.createDataFrame([("a.txt",), ("a_accumulated_section1.txt",), ("b.txt",), ("c_accumulated_section.txt",)], "name string")
    assert sorted(tuple(r) for r in pairing.section_pairs(files).collect()) == [("a", "a.txt", "a_accumulated_section1.txt"), ("b", "b.txt", None)]


@pytest.fixture
def tree(tmp_path):
    for path, body in {
        "pls/S one/a.txt": b"Plain text with more than ten words in it, so it stays for good.",
        "pls/S one/b.TXT": b"Plain text with more than ten words in it, so it stays for good.",
        "pls/c.txt": b"too short",
        "no_pls/T/d.txt": b"caf\xe9 technical text " * 8,
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body)
    return tmp_path


def test_corpus_build(spark, tree, tmp_path):
    raw = text.documents(spark, str(tree), "pls").unionByName(text.documents(spark, str(tree), "no_pls"))
    assert {(r.doc_id, r.source, r.s3_key) for r in raw.collect()} == {
        ("a", "S one", "pls/S one/a.txt"), ("b", "S one", "pls/S one/b.TXT"), ("c", "unknown", "pls/c.txt"), ("d", "T", "no_pls/T/d.txt"),
    }
    out = corpus.run(spark, str(tree), str(tmp_path / "out"), corpus.Settings(chunk_words=7))
    assert [r.doc_id for r in out["pls_clean"].collect()] == ["a"]
    assert out["no_pls_clean"].first().text.startswith("caf technical")
    units = spark.read.parquet(str(tmp_path / "out/augmented_train.parquet")).where("label = 'pls'").orderBy("unit_id").collect()
    assert [(r.unit_id, r.n_words) for r in units] == [("a_c0", 7), ("a_c1", 7)]


def test_directory_processing(spark, tree):
    out = corpus.process_directory(spark, str(tree), cleaning.Options(), 4, 1, {"labeling": {"pls_patterns": ["/s one/"]}})
    docs = {r.source_path: r for r in corpus.summary_rows(out["documents"]).collect()}
    assert docs["pls/S one/a.txt"].label == "PLS" and docs["no_pls/T/d.txt"].label == "NO_PLS"
    ids = {r.document_id for r in out["chunks"].where("source_path = 'pls/c.txt'").collect()}
    assert ids == {"pls_c.txt_chunk0000"}
    assert "café" in out["chunks"].where("source_path = 'no_pls/T/d.txt'").first().chunk_text
    with pytest.raises(FileNotFoundError):
        corpus.process_directory(spark, str(tree / "missing"))
    (tree / "empty").mkdir()
    with pytest.raises(ValueError, match="no text files"):
        corpus.process_directory(spark, str(tree / "empty"))


def test_sinks_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("x/a.txt", "one, \"two\"\nthree", "PLS"), ("b", None, "NO_PLS")], "document_id string, chunk_text string, label string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r.label for r in tables.read_csv(spark, str(tmp_path / "csv")).collect()) == ["NO_PLS", "PLS"]
    with zipfile.ZipFile(BytesIO(sinks.zip_texts(df, "document_id", "chunk_text"))) as z:
        assert z.namelist() == ["a_clean.txt", "b_clean.txt"]
    roots = corpus.persist_chunks(df, {"io": {"text_col": "body", "local_output_dir": str(tmp_path / "by")}})
    assert spark.read.parquet(roots[0]).columns[:3] == ["document_id", "body", "label"]
    sinks.write_parquet(df.withColumnsRenamed({"document_id": "doc_id", "chunk_text": "text"}), str(tmp_path / "main_train.parquet"))
    assert tables.read_parquets(spark, str(tmp_path), ["absent.parquet", "main_train.parquet"]).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_parquets(spark, str(tmp_path), ["absent.parquet"])
    assert tables.sample_parquet(spark, str(tmp_path / "main_train.parquet"), 1).columns == ["chunk_text"]
    made = []
    compute = lambda: made.append(1) or df
    for _ in range(2):
        assert tables.load_or_compute(spark, str(tmp_path / "cache"), compute).count() == 2
    assert made == [1]


def test_metrics_job_and_distributions(spark, small, tmp_path):
    written = jobs.metrics_job(spark, [f"{small}/documents.parquet"], str(tmp_path))
    df = spark.read.parquet(written[0]).withColumnRenamed("lang", "label")
    assert df.count() == 200 and "flesch_reading_ease" in df.columns
    density = jobs.distributions(df, ["lix"], 10)
    area = density.groupBy("label").agg(F.sum(F.col("density") * (F.col("high") - F.col("low"))).alias("a")).collect()
    assert all(r.a == pytest.approx(1.0) for r in area)


def test_listing_walk():
    pages = {"u": b'[{"name": "d", "type": "dir", "url": "v"}, {"name": "a.txt", "type": "file", "download_url": "da"}]', "v": b'[{"name": "b.TXT", "type": "file", "download_url": "db"}, {"name": "c.md", "type": "file", "download_url": "dc"}]'}
    assert list(listing.walk("u", fetch=pages.__getitem__)) == [("d/b.TXT", "db"), ("a.txt", "da")]


def test_listing_source_reads_files_over_http(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            base = f"http://127.0.0.1:{self.server.server_port}"
            pages = {
                "/list": [{"name": "sub", "type": "dir", "url": f"{base}/sub"}, {"name": "a.txt", "type": "file", "download_url": f"{base}/a"}],
                "/sub": [{"name": "b.TXT", "type": "file", "download_url": f"{base}/b"}, {"name": "c.csv", "type": "file", "download_url": f"{base}/c"}],
            }
            body = json.dumps(pages[self.path]).encode() if self.path in pages else f"text of {self.path} é".encode() + b"\xff"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(listing.ListingSource)
    read = spark.read.format("textloom_listing").option("url", f"http://127.0.0.1:{server.server_port}/list").load()
    assert sorted(tuple(r) for r in read.collect()) == [("a.txt", "text of /a é"), ("sub/b.TXT", "text of /b é")]
    server.shutdown()


def test_command_line(spark, small, tmp_path):
    jobs.main(["metrics", "--input", f"{small}/documents.parquet", "--output-dir", str(tmp_path), "--family", "b"])
    made = spark.read.parquet(str(tmp_path / "documents_metrics.parquet"))
    assert made.count() == 200 and "yule_k" in made.columns
    made.withColumn("label", F.lit("x")).write.parquet(str(tmp_path / "m"))
    jobs.main(["distributions", "--input", str(tmp_path / "m"), "--out", str(tmp_path / "bins"), "--metrics", "flesch", "--bins", "5"])
    assert sum(r.density * (r.high - r.low) for r in spark.read.parquet(str(tmp_path / "bins")).collect()) == pytest.approx(1.0)
    (tmp_path / "s.csv").write_text("prediction,reference\na b,a b\nx,y\n")
    jobs.main(["score", "--input", str(tmp_path / "s.csv"), "--out", str(tmp_path / "scores")])
    assert {(r.document_id, r.rouge_f1) for r in spark.read.parquet(str(tmp_path / "scores")).collect()} == {("row_0", 1.0), ("row_1", 0.0)}


def test_config_archives_and_schema_helpers(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("io:\n  text_col: body\n")
    assert tables.load_config(str(tmp_path / "c.yaml")) == {"io": {"text_col": "body"}} and tables.load_config(str(tmp_path / "c.yaml")) is tables.load_config(str(tmp_path / "c.yaml"))
    df = spark.createDataFrame([("pls/a.txt", "x", 1, 2.0)], "document_id string, clean_text string, n int, lix double")
    (tmp_path / "z.zip").write_bytes(sinks.zip_texts(df, "document_id", "clean_text"))
    assert tables.extract_zip(str(tmp_path / "z.zip"), str(tmp_path / "out")) == ["a_clean.txt"] and (tmp_path / "out/a_clean.txt").read_text() == "x"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.txt", "x")
    with pytest.raises(ValueError, match="unsafe"):
        tables.extract_zip(str(tmp_path / "bad.zip"), str(tmp_path / "out"))
    assert schemas.pick_column(df) == "clean_text" and schemas.pick_column(df.select("n")) == "n" and schemas.numeric_columns(df, ["n"]) == ["lix"]
    assert schemas.priority_columns(df, ["lix", "absent", "n"], 1) == ["lix"] and schemas.priority_columns(df, ["absent"], 3) == ["n"]
    assert schemas.map_columns(df.limit(0), {"clean_text": "text"}).columns == ["text"] and schemas.replace_columns(df, ["n", "x"]).columns == ["document_id", "clean_text", "lix"]
    with pytest.raises(ValueError, match="absent"):
        schemas.map_columns(df, {"absent": "text"})


def test_plugins(spark):
    df = spark.createDataFrame([("p", "the cat", "t")], "pair_id string, medical string, plain string")
    out = jobs.evaluate_generator(df, lambda: lambda prompt: prompt + "a plain answer").first()
    assert out.answer == "a plain answer" and out.valid and out.error is None

    def broken(text):
        raise RuntimeError("no")

    bad = plugins.generate(df, "medical", lambda: broken, tries=2, wait=0.0).first()
    assert bad.generated is None and bad.error == "RuntimeError: no"
    tagged = plugins.pos_ratios(df, "medical", lambda: lambda ts: [["DET", "NOUN"] for _ in ts]).first()
    assert tagged.noun_ratio == 0.5 and tagged.verb_ratio == 0.0
    vec = df.select(plugins.embedder(lambda: lambda ts: [[float(len(t))] for t in ts])(F.col("medical")).alias("v")).first()
    assert vec.v == [7.0]


def test_evaluation(spark):
    rows = [("a", 1.0, True), ("a", 3.0, True), ("b", 5.0, True), ("b", 9.0, False)]
    means = evaluate.system_means(spark.createDataFrame(rows, "s string, m double, ok boolean"), "s", ["m"], "ok")
    assert sorted(tuple(r) for r in means.collect()) == [("a", 2.0, 2, 0), ("b", 5.0, 1, 1)]
    assert evaluate.best_system(means, "s", ["m"]).first().best == "b"
    assert evaluate.pivot_delta(means, "s", ["m"], ["a", "b"], "a").first().delta_b == 3.0
    assert evaluate.mean_action(spark.createDataFrame([(4.0,), (8.0,)], "x double"), "x").first().action == 1.0


@pytest.mark.parametrize(("accuracy", "groups"), [(10_000, 100_000), (40, 0)])
def test_percentiles_equal_numpy(spark, monkeypatch, accuracy, groups):
    monkeypatch.setattr(describe, "ACCURACY", accuracy)
    monkeypatch.setattr(describe, "GROUPS", groups)
    rng = np.random.default_rng(5)
    samples = {f"n{n}": rng.normal(0, 1, n).tolist() for n in (1, 2, 3, 4, 5, 6, 9, 2000)} | {"ties": rng.integers(0, 4, 3000).astype(float).tolist(), "skew": rng.pareto(0.5, 3000).tolist(), None: [2.0] * 50 + [7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in samples.items() for v in vs], "k string, value double")
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.k: (r.n, r.q) for r in describe.percentiles(df, ["k"], shares).collect()}
    assert set(got) == set(samples)
    for k, vs in samples.items():
        assert got[k][0] == len(vs) and got[k][1] == pytest.approx(np.quantile(vs, shares).tolist())
    assert describe.percentiles(df.limit(0), ["k"], shares).count() == 0


def test_model_round_trip(spark, small, tmp_path):
    rows = ml.embedding_features(spark.read.parquet(f"{small}/embeddings.parquet").withColumn("y", F.expr("double(vec_id % 3 = 0)")), "embedding")
    model = ml.fit_logistic(rows, epochs=20, reg=0.01)
    ml.save(model, str(tmp_path / "m"))
    got = {r.vec_id: (r.predicted, r.probability) for r in ml.classify(rows.drop("features"), "embedding", ml.load(str(tmp_path / "m"))).collect()}
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    for r in rows.select("vec_id", "embedding").collect():
        p = 1 / (1 + math.exp(-(np.array(r.embedding, np.float64) @ w + b)))
        assert got[r.vec_id] == ("pls" if p > 0.5 else "no_pls", pytest.approx(max(p, 1 - p)))
    assert {p for p, _ in got.values()} == {"pls", "no_pls"}


def test_logistic_regression_is_optimal(spark):
    """Without a penalty the mean gradient over the training rows vanishes; held-out results are those of the coefficients."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 5))
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5, 0.0, 0.3] + 0.2)))).astype(float)
    rows = spark.createDataFrame([(i, [float(c) for c in x[i]], float(y[i])) for i in range(600)], "id int, v array<double>, y double")
    featured = ml.embedding_features(rows, "v")
    model = ml.fit_logistic(featured.where("id < 400"), epochs=200)
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gap = p[:400] - y[:400]
    assert np.abs(gap @ x[:400] / 400).max() < 1e-4 and abs(gap.mean()) < 1e-4
    scores = ml.evaluate(model.transform(featured.where("id >= 400")))
    assert scores["accuracy"] == pytest.approx(((p > 0.5) == y)[400:].mean())
    assert scores["log_loss"] == pytest.approx(-np.log(np.where(y == 1, p, 1 - p))[400:].mean())


def test_training_job_learns_from_the_training_side_only(spark):
    texts = [("pls" if i % 2 else "no_pls", f"{'plain easy' if i % 2 else 'technical dosage'} words number{i % 7} unique{i}") for i in range(60)]
    rows = texts + [("pls", "plain easy twice")] * 10 + [("pls", "  ")]
    df = spark.createDataFrame(rows, "label string, chunk_text string")
    model, held, history = ml.training_job(df, epochs=3)
    split = sampling.stratified_split(df.where("trim(chunk_text) <> ''").withColumn("__id", F.sha2(F.concat_ws("\x1f", "label", "chunk_text"), 256)), ["label"], "__id", 0.2, 13).collect()
    train = [r.chunk_text.split() for r in split if r.split == "train"]
    assert held.count() == len(split) - len(train) == 14 and len(split) == 70  # repeated rows stay
    grams = [w + [" ".join(p) for p in zip(w, w[1:], strict=False)] for w in train]
    df_of = Counter(g for w in grams for g in set(w))
    kept = sorted(g for g, c in df_of.items() if c >= 2)
    assert model.stages[0].vocabulary == kept
    idf = {g: math.log((1 + len(train)) / (1 + df_of[g])) + 1 for g in kept}
    for r in model.transform(held.withColumn("__terms", ml.term_array(F.col("chunk_text"))).drop("prediction", "probability")).collect():
        words = r.chunk_text.split()
        tf = Counter(words + [" ".join(p) for p in zip(words, words[1:], strict=False)])
        x = np.array([tf[g] * idf[g] for g in kept])
        assert r.features.toArray() == pytest.approx(x / np.linalg.norm(x))
    assert [h["epoch"] for h in history] == [1, 2, 3] and history[-1]["val_accuracy"] == 1.0
