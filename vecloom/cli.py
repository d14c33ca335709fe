"""``python -m vecloom.cli``: run the worker, or list vectorizers."""

from __future__ import annotations

import argparse
import json
import logging
import re
import signal
import sys
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import SparkSession

from vecloom.plans.tracking import Tracker
from vecloom.plans.vectorizers import Vectorizers
from vecloom.plans.worker import Worker


def redacted(url: str) -> str:
    """Without the password that a URL may hold."""
    return re.sub(r"(?<=://)([^/@:]*):[^/@]*@", r"\1:***@", url)


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()})


def seconds(text: str) -> timedelta:
    """60, 60s, 5m or 1h."""
    found = re.fullmatch(r"(\d+)([smh]?)", text.strip())
    if not found:
        raise argparse.ArgumentTypeError(f"no duration: {text!r}")
    return timedelta(seconds=int(found[1]) * {"": 1, "s": 1, "m": 60, "h": 3600}[found[2]])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("vecloom", description=__doc__)
    out.add_argument("command", choices=("worker", "status"))
    out.add_argument("--root", required=True, help="shared folder of catalog, queues and targets")
    out.add_argument("-i", "--vectorizer-ids", type=int, nargs="*", help="only these")
    out.add_argument("--poll-interval", type=seconds, default=timedelta(seconds=60))
    out.add_argument("--once", action="store_true", help="work off the queues and end")
    out.add_argument("--exit-on-error", action=argparse.BooleanOptionalAction, default=None)
    out.add_argument("--log-format", choices=("text", "json"), default="text")
    return out


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    said = parser().parse_args(args)
    handler = logging.StreamHandler()
    if said.log_format == "json":
        handler.setFormatter(_JsonLines())
    logging.basicConfig(level=logging.INFO, handlers=[handler])
    spark = spark or SparkSession.builder.appName("vecloom").config("spark.scheduler.mode", "FAIR").getOrCreate()
    logging.getLogger("vecloom").info("root %s", redacted(said.root))
    vectorizers = Vectorizers(spark, said.root, install=False)
    if said.command == "status":
        vectorizers.status().orderBy("id").show(truncate=False)
        return 0
    worker = Worker(vectorizers, said.vectorizer_ids, said.poll_interval, said.once, said.exit_on_error, Tracker(spark, f"{said.root}/tracking", interval=said.poll_interval))
    try:
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: worker.stop())
    except ValueError:
        pass  # not the main thread
    try:
        worker.run()
    except Exception:
        logging.getLogger("vecloom").exception("the worker ended")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
