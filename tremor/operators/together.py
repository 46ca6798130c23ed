"""Independent Spark jobs submitted side by side.

A model fit on a rollup table is a long row of jobs of a task or two; fits
that do not need each other's results leave most cores idle when they run one
after the other.  Each callable gets a thread of its own that inherits the
caller's local properties and, under a fair scheduler, a pool of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def side_by_side(spark: SparkSession, calls: Sequence[Callable[[], Any]], at_once: int = 8) -> list[Any]:
    """Results of the calls in their order; the first error is raised once all
    have ended.  At most ``at_once`` run at a time."""
    calls = list(calls)
    if len(calls) < 2:
        return [call() for call in calls]

    def in_pool(number: int, call: Callable[[], Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{number}")
        return call()

    with ThreadPoolExecutor(min(at_once, len(calls))) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(in_pool), number, call) for number, call in enumerate(calls)]
        return [w.result() for w in waiting]
