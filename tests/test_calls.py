"""Resumable calls: with failures injected every request is answered or listed once, none called again after its commit."""

import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import calls, ml
from textloom.plans import jobs


def service(log, stop=False):
    """A factory of a service that writes down its calls; some requests fail at first, some always, one stops the task."""

    def make():
        def model(prompt):
            n = int(prompt.split()[-1])
            with open(log, "a") as file:
                file.write(f"{n}\n")
            with open(log) as file:
                seen = file.read().split().count(str(n))
            if n % 10 == 3:
                raise ValueError("always")
            if n % 10 == 4:
                raise calls.Rejected("no use")
            if n % 10 == 5 and seen == 1:
                raise TimeoutError("at first")
            if stop and n == 77:
                raise SystemExit  # not an error of the call: the task dies
            return f"answer {n}"

        return model

    return make


LIMITS = calls.Limits(tries=3, wait=0.0, tasks=2, batches=5)


def requests(spark, n=100):
    return spark.range(n).select(F.col("id").alias("key"), F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"))


def counted(log):
    return Counter(map(int, log.read_text().split()))


def test_interrupted_calls_are_taken_up_again(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "answers")
    with pytest.raises(Exception):  # noqa: B017, PT011
        calls.answer(requests(spark), folder, service(str(log), stop=True), limits=LIMITS)
    committed = {int(r.key) for r in calls.committed(spark, folder).collect()}
    assert committed and 77 not in committed
    before = counted(log)
    got = {int(r.key): r for r in calls.answer(requests(spark), folder, service(str(log)), limits=LIMITS).collect()}
    after = counted(log)
    assert all(after[k] == before[k] for k in committed)  # none of them is called again
    assert set(got) == set(range(100))
    for n, r in got.items():
        dead = n % 10 in (3, 4)
        assert (r.answer is None) == dead and (r.error is not None) == dead
        assert r.answer is None or r.answer == f"answer {n}"
    assert {int(r.key): (r.error, r.tries) for r in calls.dead_letters(spark, folder).collect()} == {n: ("ValueError: always", 3) if n % 10 == 3 else ("Rejected: no use", 1) for n in range(100) if n % 10 in (3, 4)}
    # A third run has nothing to do; a fourth calls new requests and, asked to, dead letters.
    calls.answer(requests(spark), folder, service(str(log)), limits=LIMITS)
    assert counted(log) == after
    more = calls.answer(requests(spark, 103), folder, service(str(log)), limits=LIMITS, retry_dead=True)
    assert more.count() == 103
    assert {k for k, c in counted(log).items() if c != after[k]} == {100, 101, 102} | {n for n in range(100) if n % 10 in (3, 4)}


def test_equal_keys_nulls_and_no_requests(spark, tmp_path):
    log = tmp_path / "log"
    rows = spark.createDataFrame([("a", "prompt 2", 1), ("a", "prompt 1", 2), (None, "prompt 6", 3)], "key string, prompt string, answer int")
    got = calls.answer(rows, str(tmp_path / "x"), service(str(log)), limits=LIMITS)
    assert sorted((r.key, r.answer) for r in got.collect()) == [("", "answer 6"), ("a", "answer 1")]
    assert counted(log) == {1: 1, 6: 1}
    assert calls.answer(rows.limit(0), str(tmp_path / "y"), service(str(log)), limits=LIMITS).count() == 0


def test_pace_and_waits():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = calls.Pace(4.0, lambda: now[0], sleep)
    for _ in range(5):
        pace()
    assert now[0] == pytest.approx(1.0)
    now[0] += 10
    pace()
    pace()
    assert now[0] == pytest.approx(11.25)  # the pause isn't made up for
    waits = []

    def broken(prompt):
        raise OSError("x")

    assert calls.call(broken, "p", calls.Limits(tries=4, wait=0.5), lambda: None, waits.append) == (None, "OSError: x", 4)
    assert waits == [0.5, 1.0, 2.0]


@pytest.fixture
def plugin(tmp_path, monkeypatch, spark):
    (tmp_path / "own_generator.py").write_text("def make(style='plain'):\n    return lambda prompt: prompt + style + ' words for ' + str(len(prompt))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_generator.py"))
    yield "own_generator:make"
    sys.modules.pop("own_generator", None)


def test_inference_command(spark, small, tmp_path, plugin, capsys):
    (tmp_path / "t.txt").write_text("a medical text")
    jobs.main(["infer", "--generator", plugin, "--option", "style=easy", "--file", str(tmp_path / "t.txt")])
    assert "easy words for" in capsys.readouterr().out
    for _ in range(2):
        jobs.main(["infer", "--generator", plugin, "--input", f"{small}/documents.parquet", "--out", str(tmp_path / "made")])
    made = spark.read.parquet(str(tmp_path / "made/answers"))
    assert made.count() == 200 and made.where("answer LIKE 'plain words for %' AND error IS NULL AND tries = 1").count() == 200
    with pytest.raises(SystemExit):
        jobs.main(["infer", "--generator", plugin])


def test_classification_command(spark, tmp_path):
    texts = [("pls" if i % 2 else "no_pls", f"{'plain easy' if i % 2 else 'technical dosage'} words number{i % 7}") for i in range(60)]
    df = spark.createDataFrame(texts, "label string, chunk_text string")
    model, _, _ = ml.training_job(df, epochs=2, rate=0.5)
    ml.save(model, str(tmp_path / "m"))
    df.write.parquet(str(tmp_path / "in"))
    jobs.main(["classify", "--input", str(tmp_path / "in"), "--model", str(tmp_path / "m"), "--out", str(tmp_path / "out")])
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 60 and done.where("predicted = label AND probability > 0.5").count() == 60
