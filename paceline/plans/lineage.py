"""Cutting lineage in iterative plans, so that they stay short and survive lost executors."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (spark.checkpoint.dir). Where none is set, as in
    tests on one machine, a temporary folder becomes the checkpoint folder; a cluster must name one."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="paceline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: computed once, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the checkpoint folder and read back; for results that are read
    more than once (columns stay prunable, and the files are compressed)."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def folder(spark: SparkSession, path: str):
    """(file system, path) of a folder that all executors share."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = folder(spark, path)
    fs.delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes what ``store`` wrote, once nothing reads it any more."""
    if getattr(df, "_stored_at", None):
        remove(df.sparkSession, df._stored_at)


def save_version(spark: SparkSession, path: str, version: int, value) -> None:
    """The driver's state as version ``version`` of a folder; older versions go after a successful write."""
    row = pa.table({"state": pa.array([cloudpickle.dumps(value)], pa.binary())})
    spark.createDataFrame(row).write.mode("overwrite").parquet(f"{path}/ck-{version}")
    for old in versions(spark, path):
        if old < version:
            remove(spark, f"{path}/ck-{old}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions in a folder, in order."""
    fs, p = folder(spark, path)
    if not fs.exists(p):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(p)]
    done = [n for n, at in names if n.startswith("ck-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))]
    return sorted(int(n[3:]) for n in done)


def load_version(spark: SparkSession, path: str):
    """The state of the last complete version; None if there is none. The folder must be the fit's own."""
    known = versions(spark, path)
    return pickle.loads(spark.read.parquet(f"{path}/ck-{known[-1]}").first().state) if known else None
