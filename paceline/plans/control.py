"""Running queries as jobs: admission, progress, states, a registry and a runner."""

from __future__ import annotations

import logging
import logging.handlers
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def progress(spark: SparkSession) -> list[dict]:
    """The stages that run now, with their tasks: all, active, done, failed."""
    tracker = spark.sparkContext.statusTracker()
    info = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    return [{"stage": i.stageId, "name": i.name, "tasks": i.numTasks, "active": i.numActiveTasks, "done": i.numCompletedTasks, "failed": i.numFailedTasks} for i in info if i]


def free_slots(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism - sum(s["active"] for s in progress(spark))


def admitted(spark: SparkSession, tasks: int, poll_s: float = 2.0, most_s: float = 600.0, free: Callable[[], int] | None = None) -> bool:
    """Waits until so many slots are free; False if they are not in time. More than the cluster has is an error."""
    if tasks > spark.sparkContext.defaultParallelism:
        raise ValueError(f"{tasks} tasks need more than the {spark.sparkContext.defaultParallelism} slots of the cluster")
    end = time.monotonic() + most_s
    while (free or (lambda: free_slots(spark)))() < tasks:
        if time.monotonic() >= end:
            return False
        time.sleep(poll_s)
    return True


def logger(path: str | None = None, most_bytes: int = 1 << 20, kept: int = 2) -> logging.Logger:
    """The log of runs; in a file it keeps at most ``kept`` older parts of ``most_bytes``."""
    log = logging.getLogger("paceline.run")
    log.setLevel(logging.INFO)
    log.handlers[:] = [logging.handlers.RotatingFileHandler(path, maxBytes=most_bytes, backupCount=kept) if path else logging.StreamHandler()]
    return log


def run(spark: SparkSession, queries: dict[str, Callable[[SparkSession, str], DataFrame]], name: str, sf_dir: str, output: str | None = None, log: logging.Logger | None = None) -> str:
    """Runs a query under a job group of its name, which ``kill`` stops: to parquet in ``output``, or only for its
    time. Returns the state that it ends in."""
    log = log or logger()
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    began = time.monotonic()
    try:
        out = queries[name](spark, sf_dir).write.mode("overwrite")
        out.parquet(output) if output else out.format("noop").save()
        state = "SUCCEEDED"
    except Exception as e:  # noqa: BLE001
        state = "KILLED" if "cancelled" in str(e) else "FAILED"
        log.error("%s: %s", name, str(e).splitlines()[0] if str(e) else type(e).__name__)
    log.info("%s %s after %.1f s", name, state, time.monotonic() - began)
    return state


def kill(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)
