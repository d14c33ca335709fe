"""The worker: all vectorizers, again and again, each in a thread of its own."""

from __future__ import annotations

import logging
import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta


from vecloom.plans.tracking import Tracker
from vecloom.plans.vectorizers import Vectorizer, Vectorizers

log = logging.getLogger("vecloom.worker")


class Worker:
    """``ids``: only these; ids that don't exist are logged, or with ``strict`` an error. The first error is raised once all vectorizers have ended, if ``exit_on_error``."""

    def __init__(
        self, vectorizers: Vectorizers, ids: Sequence[int] | None = None, poll: timedelta = timedelta(seconds=60), once: bool = False, exit_on_error: bool | None = None, tracker: Tracker | None = None, strict: bool = False, threads: int = 10
    ) -> None:
        self.vectorizers, self.ids, self.poll, self.once, self.tracker, self.strict, self.threads = vectorizers, ids, poll, once, tracker, strict, threads
        self.exit_on_error = once if exit_on_error is None else exit_on_error
        self.stopped = threading.Event()

    def stop(self) -> None:
        """Ends after the pass that is running."""
        self.stopped.set()

    def run(self) -> None:
        if self.tracker:
            self.tracker.start()
            self.tracker.run()
        try:
            while not self.stopped.is_set():
                self.turn()
                if self.tracker:
                    self.tracker.check()
                if self.once or self.stopped.wait(self.poll.total_seconds()):
                    break
        finally:
            if self.tracker:
                self.tracker.stop()

    def turn(self) -> None:
        """Every vectorizer's queue once."""
        found = [v for v in self.vectorizers.list(self.ids) if not v.disabled]
        lacking = set(self.ids or ()) - {v.id for v in self.vectorizers.list(self.ids)}
        if lacking:
            if self.strict:
                raise KeyError(f"no vectorizers {sorted(lacking)}")
            log.warning("no vectorizers %s", sorted(lacking))
        with ThreadPoolExecutor(max(1, min(self.threads, len(found)))) as pool:
            ended = list(pool.map(self._one, found))
        errors = [e for e in ended if e]
        if errors and self.exit_on_error:
            raise errors[0]

    def _one(self, v: Vectorizer) -> Exception | None:
        try:
            self.vectorizers.sync(v.id)
            done = self.vectorizers.run(v.id, self.stopped.is_set)
        except Exception as e:
            log.exception("vectorizer %s", v.id)
            self.vectorizers.record_error(v.id, "vectorizer failed", {"error_reason": str(e)[:2000]})
            self._tell(v.id, 0, 1, str(e)[:2000])
            return e
        message = f"{done.failed + done.retry} keys failed" if done.failed + done.retry else None
        self._tell(v.id, done.embedded, done.failed + done.retry, message)
        return RuntimeError(message) if message else None

    def _tell(self, vid: int, successes: int, errors: int, message: str | None) -> None:
        if self.tracker and (successes or errors):
            self.tracker.count(successes, errors, message)
            self.tracker.progress(vid, successes, message)
