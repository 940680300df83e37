"""Time limits for actions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

R = TypeVar("R")
#: Seconds that the graph run allows for its reads: of the files, of the symbols of each file, and of the references (fixed values).
LIMITS = {"files": 10.0, "symbols": 5.0, "references": 10.0}


def within(spark: SparkSession, seconds: float, action: Callable[[], R]) -> R:
    """The result of ``action``, or TimeoutError after ``seconds``; its Spark jobs are then cancelled."""
    group = f"refweave-{uuid.uuid4().hex}"
    got: list[R] = []
    failed: list[BaseException] = []

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "limited", interruptOnCancel=True)
        try:
            got.append(action())
        except BaseException as e:  # noqa: BLE001
            failed.append(e)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        raise TimeoutError(f"not done after {seconds} s")
    if failed:
        raise failed[0]
    return got[0]
