"""Threads that run model fits side by side and stop together.

A fit is a chain of Spark jobs. Jobs of one pool carry its tag, so that when one
task fails, or the caller leaves, the jobs of all others are cancelled at once
instead of running on without a reader.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import CancelledError, Future, ThreadPoolExecutor, as_completed, wait

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# The scheduler pool of these jobs, which counts where the application schedules fairly.
SCHEDULER_POOL = "panelweave-fits"


class FitPool:
    """At most ``parallelism`` tasks at a time, of all callers together."""

    def __init__(self, spark: SparkSession, parallelism: int) -> None:
        self.spark = spark
        self.tag = f"panelweave-fits-{uuid.uuid4().hex}"
        self._stopped = threading.Event()
        self._error: BaseException | None = None
        self._threads = ThreadPoolExecutor(parallelism, thread_name_prefix=self.tag)
        self._tasks: list[Future] = []

    def __enter__(self) -> FitPool:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            self.stop()
        self._threads.shutdown(wait=True)
        # Of several callers that were stopped, the one that failed says why.
        if self._error is not None and error is not self._error:
            raise self._error

    def _one(self, work: Callable, task: object) -> object:
        if self._stopped.is_set():
            raise CancelledError
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.setLocalProperty("spark.scheduler.pool", SCHEDULER_POOL)
        try:
            return work(task)
        finally:
            context.removeJobTag(self.tag)
            context.setLocalProperty("spark.scheduler.pool", None)

    def run(self, work: Callable, tasks: Iterable) -> Iterator:
        """``work`` of each task, as they end. The first error stops the whole pool."""
        # A wrapper for each task: threads of one wrapper share their properties, tags among them.
        futures = [
            self._threads.submit(inheritable_thread_target(self.spark)(self._one), work, task)
            for task in tasks
        ]
        self._tasks += futures
        try:
            for future in as_completed(futures):
                yield future.result()
        except BaseException as error:
            if isinstance(error, Exception) and not self._stopped.is_set():
                self._error = error
            self.stop()
            raise

    def stop(self) -> None:
        """Start no task any more, cancel the jobs of those that run, and wait for them."""
        self._stopped.set()
        for future in self._tasks:
            future.cancel()
        while True:
            # A fit between two jobs starts one more, which goes in the next round.
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            if not wait(self._tasks, timeout=0.2).not_done:
                return
