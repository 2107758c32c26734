"""Cancelling and watching jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession

from packsmith.errors import CancelledError


class CancelToken:
    """Cancels the Spark jobs that run under it, and refuses further phases."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tag, self.cancelled = spark, f"packsmith-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self, phase: str = "") -> None:
        if self.cancelled:
            raise CancelledError(f"cancelled during {phase}" if phase else "cancelled")

    @contextmanager
    def running(self, phase: str = ""):
        """Jobs started inside belong to this token."""
        self.check(phase)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield self
        except Exception as e:
            if self.cancelled:
                raise CancelledError(f"cancelled during {phase}") from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)


def progress(spark: SparkSession, report: Callable[[int, int, str], None], phase: str = "") -> None:
    """Report finished and total tasks of the running stages, once."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    report(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages), phase)


def text_bar(write: Callable[[str], object], step: int = 5) -> Callable[[int, int, str], None]:
    """A progress function that writes a line at every step of so many per cent."""
    last = -1

    def show(done: int, total: int, phase: str) -> None:
        nonlocal last
        now = 100 * done // total // step * step if total else 100
        if now != last:
            last = now
            write(f"{phase}: {now}%")

    return show
