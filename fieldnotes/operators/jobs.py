"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list:
    """Results of a few independent jobs, submitted at once so that none waits for another's last tasks."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [running.result() for running in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
