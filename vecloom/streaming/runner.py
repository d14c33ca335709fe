"""Vectorizers driven by a Structured Streaming change feed."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vecloom.plans.vectorizers import Vectorizers


def read_changes(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", **options: Any) -> DataFrame:
    """A stream of files of events: op (I, U or D), the key, and if known ``old_<key>`` and ``changed``."""
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def start(vectorizers: Vectorizers, vid: int, events: DataFrame, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Each micro-batch is queued under its own number, then the queue is worked off.

    A batch that is run again after a failure finds its number and isn't queued twice; keys left by a pass that broke off are
    taken by the next. ``trigger``: as of ``DataStreamWriter.trigger``, all that is there and then stop by default.
    """
    query_id = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def process(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            vectorizers.apply_changes(vid, batch, token=f"{query_id}-{number}")
        finally:
            batch.unpersist()
        vectorizers.run(vid)

    return events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
