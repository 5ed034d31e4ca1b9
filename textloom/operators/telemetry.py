"""Progress of jobs, batches and streams: rows, rate and remaining time.

A job is watched from a thread that asks Spark how many of its tasks are done;
its rows are counted at the end by what the caller names, such as the footers of
the files it has written. (An ``Observation`` in the plan would count them, too,
but a session that has held one can't serialise MLlib's logistic models.) A
stream is watched by a listener, batch by batch.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Progress:
    """One report. ``rows`` and ``rate`` are None while a job runs, ``remaining`` where it can't be told."""

    name: str
    seconds: float
    share: float | None = None
    rows: int | None = None
    rate: float | None = None
    remaining: float | None = None
    batch: int | None = None
    done: bool = False

    def __str__(self) -> str:
        parts = [f"[{self.name}]"]
        if self.batch is not None:
            parts.append(f"batch {self.batch}")
        if self.rows is not None:
            parts.append(f"{self.rows} rows")
        if self.share is not None:
            parts.append(f"({100 * self.share:5.1f}%)")
        parts.append(f"elapsed {self.seconds / 60:.1f} min")
        if self.remaining is not None:
            parts.append(f"ETA {self.remaining / 60:.1f} min")
        if self.rate is not None:
            parts.append(f"{self.rate:.1f} rows/s")
        return " ".join([*parts, "done"] if self.done else parts)


Report = Callable[[Progress], None]


def say(progress: Progress) -> None:
    print(progress, flush=True)


def rows_of(spark: SparkSession, path: str) -> Callable[[], int]:
    """The rows of a Parquet table, which are counted in its footers."""
    return lambda: spark.read.parquet(path).count()


def estimate(seconds: float, share: float) -> float | None:
    """The time that is left, if the rest goes as fast."""
    return seconds * (1 - share) / share if share > 0 else None


class Watch:
    """A job under watch: ``with Watch(spark, "metrics", rows=...): df.write...`` reports every ``every`` seconds and at the end.

    ``rows`` is called once, after the job. ``reports`` keeps all reports,
    ``progress`` the last one. The jobs of the thread that enters are counted,
    with the tasks of the stages known so far.
    """

    def __init__(self, spark: SparkSession, name: str, every: float = 5.0, rows: Callable[[], int] | None = None, report: Report = say) -> None:
        self.spark, self.name, self.every, self.rows, self.report = spark, name, every, rows, report
        self.group = f"textloom-{uuid.uuid4().hex}"
        self.reports: list[Progress] = []
        self._over = threading.Event()

    def share(self) -> float | None:
        """The share of the tasks that is done, of the stages that have been planned."""
        status = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in status.getJobIdsForGroup(self.group):
            info = status.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if found := status.getStageInfo(stage):
                    done, total = done + found.numCompletedTasks, total + found.numTasks
        return done / total if total else None

    def _tell(self, progress: Progress) -> None:
        self.reports.append(progress)
        self.report(progress)

    def _poll(self) -> None:
        while not self._over.wait(self.every):
            share, seconds = self.share(), time.monotonic() - self.began
            self._tell(Progress(self.name, seconds, share, remaining=estimate(seconds, share) if share else None))

    def __enter__(self) -> Watch:
        self.began = time.monotonic()
        self.spark.sparkContext.setJobGroup(self.group, self.name)
        self.thread = threading.Thread(target=self._poll, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, kind, value, trace) -> None:
        self._over.set()
        self.thread.join()
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        self.spark.sparkContext.setLocalProperty("spark.job.description", None)
        if kind is None:
            seconds = time.monotonic() - self.began
            rows = self.rows() if self.rows else None
            self._tell(Progress(self.name, seconds, 1.0, rows, rows / seconds if rows is not None and seconds else None, 0.0, done=True))

    @property
    def progress(self) -> Progress:
        return self.reports[-1]


class StreamWatch(StreamingQueryListener):
    """Reports of every batch of a session's streams: its rows, the rate since the start, and the time left of ``total`` rows."""

    def __init__(self, name: str | None = None, total: int | None = None, report: Report = say) -> None:
        self.only, self.total, self.report = name, total, report
        self.reports: list[Progress] = []
        self.rows: dict[str, int] = {}
        self.began: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        self.began[str(event.runId)] = time.monotonic()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.only and p.name != self.only:
            return
        run = str(p.runId)
        rows = self.rows[run] = self.rows.get(run, 0) + p.numInputRows
        seconds = time.monotonic() - self.began.setdefault(run, time.monotonic() - p.batchDuration / 1000)
        rate = rows / seconds if seconds > 0 else None
        left = max(0.0, (self.total - rows) / rate) if self.total is not None and rate else None
        share = min(1.0, rows / self.total) if self.total else None
        self._tell(Progress(p.name or run, seconds, share, rows, rate, left, p.batchId))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _tell(self, progress: Progress) -> None:
        self.reports.append(progress)
        self.report(progress)
