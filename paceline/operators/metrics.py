"""Objective histories, progress, sync times and messages over report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def once(reports: DataFrame) -> DataFrame:
    """Each (job, superstep, task) once: the latest report; equal times go to the larger value."""
    key = ["job_id", "superstep", "task_id"]
    rest = [c for c in reports.columns if c not in key]
    best = reports.groupBy(*key).agg(F.max(F.struct("reported_at", *[c for c in rest if c != "reported_at"])).alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def objective_history(reports: DataFrame) -> DataFrame:
    """(job_id, superstep, objective, running, progress): sums over tasks, running totals and falls. Null and
    NaN aggregates count as 0."""
    v = F.when(F.isnan("task_agg"), 0.0).otherwise(F.coalesce("task_agg", F.lit(0.0)))
    s = once(reports).groupBy("job_id", "superstep").agg(F.sum(v).alias("objective"))
    w = W.partitionBy("job_id").orderBy("superstep")
    run = F.sum("objective").over(w.rowsBetween(W.unboundedPreceding, 0))
    delta = F.coalesce(F.lag("objective").over(w) - F.col("objective"), F.lit(0.0))
    return s.select("job_id", "superstep", "objective", run.alias("running"), delta.alias("progress"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at n/2 of the sorted values: of two middle ones the upper."""
    w, all_ = W.partitionBy(*by).orderBy(value), W.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(all_))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2)).select(*by, F.col(value).alias("median"))


def progress(reports: DataFrame) -> DataFrame:
    """(job_id, superstep, slowest, fastest, least, most): tasks by points read; ties to the least task."""
    r = once(reports).where("points_read is not null and task_id is not null")
    low, high = F.min(F.struct("points_read", "task_id")), F.max(F.struct(F.col("points_read"), (-F.col("task_id")).alias("t")))
    out = r.groupBy("job_id", "superstep").agg(low.alias("l"), high.alias("h"))
    return out.select("job_id", "superstep", F.col("l.task_id").alias("slowest"), (-F.col("h.t")).alias("fastest"), F.col("l.points_read").alias("least"), F.col("h.points_read").alias("most"))


def counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counters (sums of the columns given, and rows) that any action on it fills."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows"), *[F.sum(c).alias(n) for n, c in counters.items()]), seen


def barrier_times(reports: DataFrame) -> DataFrame:
    """(job_id, superstep, tasks, compute_ms, sync_ms): of each barrier its reports, the slowest task and the mean wait."""
    r = once(reports)
    return r.groupBy("job_id", "superstep").agg(F.count("*").alias("tasks"), F.max("run_ms").alias("compute_ms"), F.avg("sync_ms").alias("sync_ms"))


def combined_messages(df: DataFrame, destination: str, value: str, how: str = "sum") -> DataFrame:
    """Messages combined by destination, before and after the shuffle."""
    return df.where(F.col(destination).isNotNull()).groupBy(destination).agg({"sum": F.sum, "min": F.min, "max": F.max}[how](value).alias("value"))
