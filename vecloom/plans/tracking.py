"""Worker health and progress, as folds of events.

Workers append heartbeats and progress; nothing is updated in place. Events: heartbeats have worker_id, at, successes, errors, message;
progress has vectorizer_id, worker_id, at, successes, message. A message makes it an error.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from vecloom.sources.store import Table

STARTS = StructType([StructField("worker_id", StringType()), StructField("version", StringType()), StructField("started", TimestampType()), StructField("interval_s", LongType())])
BEATS = StructType([*[StructField("worker_id", StringType()), StructField("at", TimestampType())], StructField("successes", LongType()), StructField("errors", LongType()), StructField("message", StringType())])
PROGRESS = StructType(
    [StructField("vectorizer_id", LongType()), StructField("worker_id", StringType()), StructField("at", TimestampType()), StructField("successes", LongType()), StructField("message", StringType())]
)
FATAL_LOSS = "VECLOOM_FAIL_ON_HEARTBEAT_LOSS"


def _last(value: Column, at: Column, when: Column) -> Column:
    """The value of the last event for which ``when`` holds; of events at one time, the greatest."""
    return F.max(F.when(when, F.struct(at, value.alias("v"))))["v"]


def heartbeat_fold(beats: DataFrame) -> DataFrame:
    """last_heartbeat, heartbeat_count, success_count, error_count, last_error_at and last_error_message of each worker."""
    failed = F.col("message").isNotNull()
    return beats.groupBy("worker_id").agg(
        F.max("at").alias("last_heartbeat"),
        F.count("*").alias("heartbeat_count"),
        F.sum("successes").alias("success_count"),
        F.sum("errors").alias("error_count"),
        F.max(F.when(failed, F.col("at"))).alias("last_error_at"),
        _last(F.col("message"), F.col("at"), failed).alias("last_error_message"),
    )


def progress_fold(progress: DataFrame) -> DataFrame:
    """Counts and the last success and error of each vectorizer, whoever worked on it. A message counts as one error."""
    failed = F.col("message").isNotNull()
    return progress.groupBy("vectorizer_id").agg(
        F.sum("successes").alias("success_count"),
        F.sum(failed.cast("long")).alias("error_count"),
        F.max(F.when(~failed, F.col("at"))).alias("last_success_at"),
        _last(F.col("worker_id"), F.col("at"), ~failed).alias("last_success_process_id"),
        F.max(F.when(failed, F.col("at"))).alias("last_error_at"),
        _last(F.col("message"), F.col("at"), failed).alias("last_error_message"),
        _last(F.col("worker_id"), F.col("at"), failed).alias("last_error_process_id"),
        F.max("at").alias("updated_at"),
    )


def processes(starts: DataFrame, beats: DataFrame) -> DataFrame:
    """A row per worker; one without a heartbeat was last heard of when it started."""
    out = starts.join(heartbeat_fold(beats), "worker_id", "left").withColumn("last_heartbeat", F.coalesce("last_heartbeat", "started"))
    return out.fillna(0, ["heartbeat_count", "success_count", "error_count"])


def _limit(now: Column | datetime) -> Column:
    now = now if isinstance(now, Column) else F.lit(now)
    return now - F.make_dt_interval(secs=F.col("interval_s") * 2)


def stale_workers(workers: DataFrame, now: Column | datetime) -> DataFrame:
    """Not heard of for two intervals."""
    return workers.where(F.col("last_heartbeat") < _limit(now))


def active_workers(workers: DataFrame, now: Column | datetime) -> DataFrame:
    return workers.where(F.col("last_heartbeat") > _limit(now))


def expired_workers(workers: DataFrame, now: Column | datetime, days: int = 7) -> DataFrame:
    """Those whose rows may go."""
    now = now if isinstance(now, Column) else F.lit(now)
    return workers.where(F.col("last_heartbeat") < now - F.make_dt_interval(days=F.lit(days)))


def health(vectorizers: DataFrame, progress: DataFrame) -> DataFrame:
    """A row per vectorizer, with its progress if there is any."""
    return vectorizers.join(progress, vectorizers["id"] == progress["vectorizer_id"], "left").select(
        "id", "source_table", "success_count", "error_count", "last_error_message", "updated_at"
    )


class Tracker:
    """A worker's own account. Counts are kept here between heartbeats and put back if one can't be written."""

    def __init__(self, spark: SparkSession, root: str, version: str = "0.1.0", interval: timedelta = timedelta(seconds=60), clock: Callable[[], datetime] | None = None) -> None:
        self.spark, self.root, self.version, self.interval = spark, root, version, interval
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.id = str(uuid.uuid4())
        self.successes = self.errors = self.lost = 0
        self.message: str | None = None
        self.healthy, self.lock, self.stopped = True, threading.Lock(), threading.Event()
        self.thread: threading.Thread | None = None

    def table(self, name: str) -> Table:
        schema, pk = {"starts": (STARTS, "worker_id"), "beats": (BEATS, "worker_id"), "progress": (PROGRESS, "vectorizer_id")}[name]
        return Table.create(self.spark, f"{self.root}/{name}", schema, [pk])

    def _append(self, name: str, row: tuple) -> None:
        table = self.table(name)
        table.append(self.spark.createDataFrame([row], table.schema))

    def start(self) -> str:
        self._append("starts", (self.id, self.version, self.clock(), int(self.interval.total_seconds())))
        return self.id

    def count(self, successes: int = 0, errors: int = 0, message: str | None = None) -> None:
        with self.lock:
            self.successes += successes
            self.errors += errors
            self.message = message if message is not None else self.message

    def heartbeat(self) -> None:
        with self.lock:
            said = self.successes, self.errors, self.message
            self.successes = self.errors = 0
            self.message = None
        try:
            self._append("beats", (self.id, self.clock(), *said))
            self.lost = 0
        except Exception:
            with self.lock:
                self.successes += said[0]
                self.errors += said[1]
                self.message = self.message if self.message is not None else said[2]
            self.lost += 1
            self.healthy = self.healthy and self.lost < 3
            raise

    def progress(self, vectorizer_id: int, successes: int, message: str | None = None) -> None:
        self._append("progress", (vectorizer_id, self.id, self.clock(), successes, message))

    def run(self) -> None:
        """Heartbeats in the background, until :meth:`stop` or three in a row are lost."""

        def loop() -> None:
            while self.healthy and not self.stopped.wait(self.interval.total_seconds()):
                try:
                    self.heartbeat()
                except Exception:
                    continue

        self.thread = threading.Thread(target=loop, daemon=True)
        self.thread.start()

    def stop(self) -> None:
        """With a last heartbeat."""
        self.stopped.set()
        if self.thread:
            self.thread.join()
        if self.healthy:
            self.heartbeat()

    def check(self) -> None:
        """Raises when heartbeats are lost and that is to be fatal."""
        if not self.healthy and os.environ.get(FATAL_LOSS, "").lower() in ("1", "true", "yes", "on"):
            raise RuntimeError("heartbeats are lost")
