"""Calls to an outside service for a table of requests, which may be interrupted and taken up again.

Requests are called in micro-batches, each of which is written as a table of its
own; Spark's commit of that table is the commit of its answers. A later run calls
only requests that no committed table has, so none is called again once its
answer is there; those of a batch that failed are. A request that fails ``tries``
times, or is rejected, is a dead letter: it is listed with its error, and called
again only if that is asked for.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, answer string, error string, tries int"


class Rejected(Exception):
    """An error that another try won't mend."""


@dataclass(frozen=True)
class Limits:
    """Tries of a request, the first wait between them (doubled each time), calls a second of all tasks together, tasks at a time, and micro-batches of a run."""

    tries: int = 3
    wait: float = 1.0
    per_second: float | None = None
    tasks: int = 8
    batches: int = 16


class Pace:
    """Lets calls pass at an even rate; a pause isn't made up for."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = (1 / per_second if per_second else 0.0), clock, sleep, 0.0

    def __call__(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def call(model: Callable[[str], str], prompt: str, limits: Limits, pace: Callable[[], None], sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(answer, error, tries) of one request."""
    said = None
    for k in range(1, limits.tries + 1):
        pace()
        try:
            return model(prompt), None, k
        except Rejected as e:
            return None, f"{type(e).__name__}: {e}", k
        except Exception as e:
            said = f"{type(e).__name__}: {e}"
            if k < limits.tries:
                sleep(limits.wait * 2 ** (k - 1))
    return None, said, limits.tries


def _called(requests: DataFrame, factory: Callable[[], Callable[[str], str]], limits: Limits) -> DataFrame:
    """Answers of (key, prompt) rows, a task's share of the rate each."""
    share = limits.per_second / limits.tasks if limits.per_second else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pace = factory(), Pace(share)
        for batch in batches:
            rows = [call(model, prompt, limits, pace) for prompt in batch.column(1).to_pylist()]
            answer, error, tries = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answer, pa.string()), pa.array(error, pa.string()), pa.array(tries, pa.int32())], ["key", "answer", "error", "tries"])

    return requests.repartition(limits.tasks, "key").mapInArrow(run, SCHEMA)


def _committed_paths(spark: SparkSession, folder: str) -> list[str]:
    """The tables below ``folder`` that were written whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    child = lambda parent, name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent, name)
    if not files.exists(path):
        return []
    return [s.getPath().toString() for s in files.listStatus(path) if s.getPath().getName().startswith("run-") and files.exists(child(s.getPath(), "_SUCCESS"))]


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(key, answer, error, tries): the last committed row of every request."""
    paths = _committed_paths(spark, folder)
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(f"{SCHEMA}, run int").parquet(*paths)
    return rows.groupBy("key").agg(F.max_by(F.struct("answer", "error", "tries"), "run").alias("x")).select("key", "x.*")


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """(key, error, tries) of the requests that were given up."""
    return committed(spark, folder).where("error IS NOT NULL").select("key", "error", "tries")


def answer(
    requests: DataFrame, folder: str, factory: Callable[[], Callable[[str], str]], key: str = "key", prompt: str = "prompt", limits: Limits = Limits(), retry_dead: bool = False,  # noqa: B008
) -> DataFrame:
    """Call the service for all requests that ``folder`` has no answers of; returns all requests' rows of ``committed``.

    ``factory`` is called once a task and returns the callable. Defined results:
    requests of equal key are one (the least prompt); a null key or prompt
    is the empty string; no requests make no calls.
    """
    spark, folder = requests.sparkSession, folder.rstrip("/")
    wanted = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(prompt).cast("string"), F.lit("")).alias("prompt")).groupBy("key").agg(F.min("prompt").alias("prompt"))
    done = committed(spark, folder)
    if retry_dead:
        done = done.where("error IS NULL")
    run = 1 + max((int(p.rstrip("/").rsplit("/", 1)[-1].split("-")[1]) for p in _committed_paths(spark, folder)), default=0)
    pending = wanted.join(done.select("key"), "key", "left_anti").withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(limits.batches)).cast("int"))
    # Written, so that a batch doesn't depend on what those before it have committed; and in order of batches, so that each reads its part.
    path = f"{folder}/_pending-{run:06d}"
    pending.write.mode("overwrite").partitionBy("batch").parquet(path)
    held = spark.read.schema("key string, prompt string, batch int").parquet(path)
    for batch in range(limits.batches):
        part = held.where(F.col("batch") == batch).select("key", "prompt")
        if not part.isEmpty():
            _called(part, factory, limits).withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{folder}/run-{run:06d}-{batch:06d}")
    return wanted.select("key").join(committed(spark, folder), "key", "left")
