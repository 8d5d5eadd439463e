"""Points from text and tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.plans.lineage import remove


def key_value(line: Column, separator: str = "\t") -> tuple[Column, Column]:
    """Key and value of a line: exactly two pieces give both, anything else the first piece and an
    empty value; trailing empty pieces do not count. ``separator`` is a regular expression. A null line
    counts as empty."""
    parts = F.split(F.regexp_replace(F.coalesce(line, F.lit("")), f"(?:{separator})+$", ""), separator)
    return F.get(parts, F.lit(0)), F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.lit(""))


def read_key_values(spark: SparkSession, paths: str | list[str], separator: str = "\t") -> DataFrame:
    """(key, value) of text files: several paths, globs and compressed files included."""
    k, v = key_value(F.col("value"), separator)
    return spark.read.text(paths).select(k.alias("key"), v.alias("value"))


def parse_vector(value: Column, kind: str = "double", separator: str = ",") -> Column:
    """A dense vector; empty text gives an empty one, a field that is no number gives null."""
    fields = F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(value, separator))
    return F.transform(fields, lambda f: F.trim(f).try_cast(kind))


def parse_pairs(value: Column) -> Column:
    """(id, weight) structs from alternating fields; a last id without a weight is left out."""
    p = F.split(value, ",")
    n = F.floor(F.size(p) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(p, 2 * i).try_cast("int").alias("id"), F.get(p, 2 * i + 1).try_cast("double").alias("weight")))


def read_points(spark: SparkSession, paths: str | list[str], separator: str = "\t") -> DataFrame:
    """(id, x) from lines ``id TAB x1,x2,...``."""
    kv = read_key_values(spark, paths, separator)
    return kv.select(F.col("key").try_cast("long").alias("id"), parse_vector(F.col("value")).alias("x"))


def parse_ratings(line: Column) -> tuple[Column, Column, Column]:
    """User, item and rating of ``user::item::rating`` with or without a time; a field that is no number is null."""
    f = F.split(line, "::")
    return F.get(f, F.lit(0)).try_cast("long"), F.get(f, F.lit(1)).try_cast("int"), F.get(f, F.lit(2)).try_cast("double")


def split_sizes(spark: SparkSession, most: int | None = None, least: int | None = None) -> dict[str, str]:
    """Sets (those given) and returns the bounds of a scan's splits in bytes."""
    names = {"spark.sql.files.maxPartitionBytes": most, "spark.sql.files.openCostInBytes": least}
    for name, value in names.items():
        if value is not None:
            spark.conf.set(name, str(value))
    return {name: spark.conf.get(name) for name in names}


def write_sequence_file(df: DataFrame, path: str) -> None:
    """Text records (key, value) of the first two columns; an existing output is replaced. The format has only an RDD writer."""
    remove(df.sparkSession, path)
    df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns[:2])).rdd.map(tuple).saveAsSequenceFile(path)


def read_sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a sequence file of texts."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path).map(lambda kv: (str(kv[0]), str(kv[1]))), "key string, value string")


def write_points(df: DataFrame, path: str) -> None:
    """Lines ``id TAB x1,x2,...``; an existing output is replaced."""
    df.select(F.concat_ws("\t", F.col("id").cast("string"), F.array_join(F.col("x").cast("array<string>"), ","))).write.mode("overwrite").text(path)


def labelled(x: Column) -> tuple[Column, Column]:
    """Features and label of a vector whose last value is the label; no intercept is added."""
    return F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.element_at(x, -1)


def with_local(df: DataFrame, local: DataFrame, first_id: int) -> DataFrame:
    """The points and those of a second source, which get ids from ``first_id`` on in the order of theirs.
    The second source is one machine's file: small, and numbered in one task."""
    from pyspark.sql import Window as W

    numbered = local.withColumn("id", F.row_number().over(W.orderBy("id")) - 1 + F.lit(first_id))
    return df.select(F.col("id").cast("long"), "x").unionByName(numbered.select(F.col("id").cast("long"), "x"))
