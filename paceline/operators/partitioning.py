"""Splits, routes, placement, job order, migration: pure rules and their table forms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.functions import vectors as V

CHUNK_POINTS = 15_000


def split_sizes(length: int, tasks: int, skew: float = 0.0) -> list[int]:
    """Sizes of the splits of a file: with skew the first is larger, all others are smaller."""
    s = math.ceil(length / tasks)
    more = math.ceil(skew * s / (skew + tasks)) if tasks > 1 and skew > 0 else 0
    sizes, left = [], length
    for i in range(tasks):
        sizes.append(min(left, s + (tasks - 1) * more if i == 0 else s - more))
        left -= sizes[-1]
    sizes[-1] += left
    return sizes


def route_table(points: DataFrame, task: str = "task", key: str = "id") -> DataFrame:
    """(task, min_id, max_id): each task's least id, up to the next task's."""
    total = points.agg(F.count("*").alias("n"), F.min(key).alias("m")).first()
    first = points.groupBy(task).agg(F.min(key).alias("min_id"))  # a row for each task
    following = F.lead("min_id").over(W.orderBy("min_id")) - 1
    return first.select(F.col(task).alias("task"), "min_id", F.coalesce(following, F.lit((total.n or 0) + (total.m or 0) - 1)).cast("long").alias("max_id"))


def task_of(points: DataFrame, routes: list[tuple[int, int]], key: str = "id") -> DataFrame:
    """``points`` with the task whose range holds the id, by bounds in a literal (a bound for each task)."""
    routes = sorted(routes, key=lambda r: r[1])
    bounds = F.array(*[F.lit(int(m)) for _, m in routes])
    at = F.size(F.filter(bounds, lambda b: b <= F.col(key)))
    return points.withColumn("task", F.when(at > 0, F.get(F.array(*[F.lit(int(t)) for t, _ in routes]), at - 1)))


def min_id(points: DataFrame, task: str = "task", key: str = "id", tasks: int | None = None) -> DataFrame:
    """(task, min_id): the least id of each task; -1 for a task (of 0..tasks-1) without points."""
    found = points.groupBy(F.col(task).cast("int").alias("task")).agg(F.min(key).cast("long").alias("min_id"))
    if tasks is None:
        return found
    every = points.sparkSession.range(tasks).select(F.col("id").cast("int").alias("task"))
    return every.join(found, "task", "left").select("task", F.coalesce("min_id", F.lit(-1)).alias("min_id"))


def tasks_of_splits(sizes: list[int], slots: int, tasks: int | None = None) -> list[int]:
    """The splits, largest first, one task each; with ``tasks`` beyond them disabled ones (None) that load
    nothing. More tasks than ``slots`` is an error."""
    n = max(len(sizes), tasks or 0)
    if n > slots:
        raise ValueError(f"{n} tasks need more than the {slots} slots of the cluster")
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    return order + [None] * (n - len(order))


def skewed_tasks(numbered: DataFrame, tasks: int, skew: float, number: str = "id") -> DataFrame:
    """``numbered`` (row numbers from 0) with the task of the skewed split that holds the row."""
    sizes = split_sizes(numbered.count(), tasks, skew)
    starts = [sum(sizes[:i]) for i in range(tasks)]
    at = F.size(F.filter(V.whole_numbers(starts), lambda b: b <= F.col(number)))
    return numbered.withColumn("task", (at - 1).cast("int"))


def placement(tasks: int, workers: int, one_on_master: bool = False) -> list[int]:
    """The worker of each task: consecutive runs of equal length."""
    if one_on_master and workers > 1 and tasks > 1:
        return [0] + [1 + w for w in placement(tasks - 1, workers - 1)]
    run = math.ceil(tasks / workers)
    return [t // run for t in range(tasks)]


def placed(jobs: DataFrame, workers: int) -> DataFrame:
    """(job_id, task, worker): the same for the tasks of every job."""
    n = F.col("num_tasks")
    tasks = jobs.where(n > 0).select("job_id", "num_tasks", F.explode(F.sequence(F.lit(0), n - 1)).alias("task"))
    return tasks.select("job_id", "task", F.floor(F.col("task") / F.ceil(n / workers)).cast("int").alias("worker"))


def job_order(jobs: DataFrame) -> DataFrame:
    """``jobs`` with their rank in the queue: by priority (1 first, none last), then by time, then by id."""
    w = W.orderBy(F.coalesce("priority", F.lit(6)).cast("string"), "submitted_at", "job_id")  # a queue is short
    return jobs.withColumn("rank", F.row_number().over(w))


def move_plan(sizes: list[int], sender: int, chunk: int = CHUNK_POINTS) -> tuple[int, list[tuple[int, int, int]]]:
    """(points that stay, for each chunk of the sender's tail its task, first position there and length). Half of the
    sender's points go, in chunks to tasks +4, +8, +12 in turn; each is appended."""
    n, size = sizes[sender], list(sizes)
    size[sender] -= n // 6 * 3
    out = []
    for c, lo in enumerate(range(size[sender], n, chunk)):
        to, length = (sender + 4 * (c % 3 + 1)) % len(sizes), min(chunk, n - lo)
        out.append((to, size[to], length))
        size[to] += length
    return n - n // 6 * 3, out


def moved(points: DataFrame, sender: int, sizes: list[int], chunk: int = CHUNK_POINTS) -> DataFrame:
    """``points`` with task and pos as the plan has them: plain columns, and their state columns go with them."""
    stay, chunks = move_plan(sizes, sender, chunk)
    if not chunks:
        return points
    goes = (F.col("task") == sender) & (F.col("pos") >= stay)
    c = F.floor((F.col("pos") - stay) / chunk).cast("int")
    to, first = (F.get(V.whole_numbers(x[i] for x in chunks), c) for i in (0, 1))
    pos = F.when(goes, first + (F.col("pos") - stay) % chunk).otherwise(F.col("pos"))
    return points.withColumns({"task": F.when(goes, to.cast("int")).otherwise(F.col("task")), "pos": pos})


def moved_ranges(ranges: list[list[tuple]], sender: int, chunk: int = CHUNK_POINTS) -> list[list[tuple]]:
    """The ranges (from, to, ..) of positions of each task after the same move."""
    stay, chunks = move_plan([r[-1][1] if r else 0 for r in ranges], sender, chunk)
    cut = lambda lo, hi, to: [(max(a, lo) - lo + to, min(b, hi) - lo + to, *rest) for a, b, *rest in ranges[sender] if max(a, lo) < min(b, hi)]
    out = [list(r) for r in ranges]
    out[sender] = cut(0, stay, 0)
    for i, (to, first, length) in enumerate(chunks):
        out[to] += cut(stay + i * chunk, stay + i * chunk + length, first)
    return out


def migrated(points: DataFrame, sender: int, tasks: int, chunk: int = CHUNK_POINTS) -> DataFrame:
    """Half of the sender's points, from the tail, moved in chunks to tasks +4, +8, +12 in turn. Their
    state columns go with them. ``points`` has task and pos."""
    n = points.where(F.col("task") == sender).count()
    moved = n // 6 * 3
    turn = F.floor((F.col("pos") - (n - moved)) / chunk) % 3
    to = (F.lit(sender) + 4 * (turn + 1)) % tasks
    return points.withColumn("task", F.when((F.col("task") == sender) & (F.col("pos") >= n - moved), to.cast("int")).otherwise(F.col("task")))
