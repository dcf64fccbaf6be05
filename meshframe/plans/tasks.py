"""The task interface: callbacks registered by key, tasks submitted, waited for and timed.

Spark's scheduler does the work; a task is a named job group, with a pool for its priority and a
timer that cancels it.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .durable import durable


@dataclass
class Callbacks:
    """A task's functions: which input rows it takes, what it makes of them, how overlapping
    outputs reduce, how outputs are redistributed, and what happens at the end."""

    subtask: Callable[[DataFrame], DataFrame]
    data_distribution: Callable[[DataFrame], DataFrame] | None = None
    data_reduction: Callable[[DataFrame], DataFrame] | None = None
    data_redistribution: Callable[[DataFrame], DataFrame] | None = None
    completion: Callable[[DataFrame, object], None] | None = None


_registered: dict[str, Callbacks] = {}


def register(key: str, callbacks: Callbacks) -> str:
    if key in _registered:
        raise KeyError(f"already registered: {key}")
    _registered[key] = callbacks
    return key


def release(key: str) -> None:
    del _registered[key]


@dataclass
class Task:
    """A submitted task. result() waits; seconds is its time from start to end."""

    group: str
    spark: SparkSession
    _thread: threading.Thread | None = None
    _result: DataFrame | None = None
    _error: BaseException | None = None
    seconds: float | None = field(default=None)

    def wait(self) -> Task:
        self._thread.join()
        return self

    def result(self) -> DataFrame:
        self.wait()
        if self._error is not None:
            raise self._error
        return self._result

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.group)


_count = iter(range(1 << 62))


def submit(key: str, data: DataFrame, user_data: object = None, priority: str | None = None, timeout: float | None = None) -> Task:
    """Start a task over data in the background. priority: the scheduler pool to run in. After
    timeout seconds its jobs are cancelled, and result() raises."""
    from pyspark import InheritableThread

    calls, spark = _registered[key], data.sparkSession
    task = Task(f"{key}-{next(_count)}", spark)

    def run():
        began = time.monotonic()
        timer = threading.Timer(timeout, task.cancel) if timeout else None
        try:
            spark.sparkContext.setJobGroup(task.group, key, interruptOnCancel=True)
            if priority:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", priority)
            if timer:
                timer.start()
            out = calls.subtask(calls.data_distribution(data) if calls.data_distribution else data)
            for more in (calls.data_reduction, calls.data_redistribution):
                out = more(out) if more else out
            task._result = durable(out)
            if calls.completion:
                calls.completion(task._result, user_data)
        except BaseException as e:  # noqa: BLE001  handed to whoever waits
            task._error = e
        finally:
            if timer:
                timer.cancel()
            task.seconds = time.monotonic() - began

    task._thread = InheritableThread(target=run, daemon=True)
    task._thread.start()
    return task


def hosts(spark: SparkSession) -> int:
    """Executors at work, the driver's own in a local session."""
    return max(1, spark._jsc.sc().getExecutorMemoryStatus().size() - (0 if spark.sparkContext.master.startswith("local[") else 1))
