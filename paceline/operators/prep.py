"""Data preparation: ids, labels, dictionaries, ratings, generators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import vectors as V

#: A dictionary of so many values at most is broadcast; a larger one is joined by shuffles.
BROADCAST_CODES = 200_000


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``df`` with 0-based row numbers in the given order; rows that are equal in it follow a hash of all their
    columns. Rows are range-partitioned (as many ranges as the session shuffles to) and sorted in
    parallel; row counts of the partitions (few numbers) give each its first one."""
    from paceline.plans.lineage import store

    tie = F.xxhash64(*(f.name for f in df.schema if "map<" not in f.dataType.simpleString()))
    split = df.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    part = store(split.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    # a partition's rows have consecutive values of _m from its number shifted left by 33
    counts = {r._p: r["count"] for r in part.groupBy("_p").count().collect()}
    first = [0]
    for p in range(max(counts, default=0)):
        first.append(first[-1] + counts.get(p, 0))
    offset = F.get(V.whole_numbers(first), F.col("_p"))
    return part.withColumn(name, offset + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m")


def without_label(value: Column) -> Column:
    """The numbers of a label-first line; 1.0E00 notations become plain doubles."""
    return F.slice(F.split(value, ","), 2, F.size(F.split(value, ","))).cast("array<double>")


def label_last(value: Column) -> Column:
    f = F.split(value, ",").cast("array<double>")
    return F.concat(F.slice(f, 2, F.size(f)), F.slice(f, 1, 1))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value, n) over all the columns."""
    long = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).where("value is not null")
    return long.groupBy("value").agg(F.count("*").alias("n"))


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value, code): codes from 1 in value order, shared by all the columns."""
    return numbered(value_counts(df, columns).select("value"), ["value"], "code").select("value", (F.col("code") + 1).alias("code"))


def encoded(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns replaced by their codes; null stays null."""
    codes = dictionary(df, columns)
    small = codes.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES
    for c in columns:
        mine = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = df.join(F.broadcast(mine) if small else mine, F.col(c).cast("string") == F.col("_value"), "left").withColumn(c, F.col("_code")).drop("_value", "_code")
    return df


def dense_rows(ratings: DataFrame, user: str, item: str, rating: str, items: int, missing: float = 0.01) -> DataFrame:
    """(row, user, rated, v): for each user in order a dense vector over items 1..items; what is missing, null or
    outside has ``missing``. ``rated``: the ratings in it. Repeated ratings of an item: the largest."""
    inside = F.when(F.col(item).between(1, items), F.col(item).cast("int"))
    best = ratings.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("user"), inside.alias("k")).agg(F.max(rating).alias("r"))
    known = F.when(F.col("k").isNotNull() & F.col("r").isNotNull(), F.struct("k", "r"))
    by_user = best.groupBy("user").agg(F.array_sort(F.collect_list(known)).alias("e"))
    # numbered while still sparse; each rating comes after the gap before its item
    filled = lambda n: F.array_repeat(F.lit(missing), n.cast("int"))
    gap = lambda x, i: x["k"] - F.coalesce(F.get("e", i - 1)["k"], F.lit(0)) - 1
    parts = F.flatten(F.transform("e", lambda x, i: F.concat(filled(gap(x, i)), F.array(x["r"]))))
    v = F.concat(parts, filled(items - F.coalesce(F.get("e", F.size("e") - 1)["k"], F.lit(0))))
    return numbered(by_user, ["user"], "row").select("row", "user", F.size("e").cast("long").alias("rated"), v.alias("v"))


def split_at(df: DataFrame, order: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows in order, with ids, and the rest without."""
    rows = numbered(df, order, "_id")
    return rows.where(F.col("_id") < n).withColumnRenamed("_id", "id"), rows.where(F.col("_id") >= n).drop("_id")


def random_points(spark: SparkSession, n: int, d: int, seed: int = 1, scale: float = 1.0) -> DataFrame:
    """(id, x): uniform in [0, scale), the same for the same seed."""
    unit = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)) * scale
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(d)), unit).alias("x"))


def summed_points(spark: SparkSession, n: int, d: int, seed: int = 1) -> DataFrame:
    """(id, x): sums of a draw from [0, 10) and one from [0, 1)."""
    a, b = random_points(spark, n, d, seed, 10.0), random_points(spark, n, d, seed + 1)
    return a.join(b.select("id", F.col("x").alias("y")), "id").select("id", F.zip_with("x", "y", lambda p, q: p + q).alias("x"))


def sparse_matrix(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """(id, x): rows whose entries are zero but for every step-th column, with a step of 5 to 14 by row."""
    step = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10)) + 5
    value = lambda j: F.when(j % step == 0, 1.0 + F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(5))).otherwise(0.0)
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), value).alias("x"))


def inverse_cdf(name: str, u: Column, *p: float) -> Column:
    """Random variates from one uniform u in [0, 1)."""
    if name == "exponential":
        return -F.log(1 - u) / p[0]
    if name == "weibull":
        return p[0] * F.pow(-F.log(1 - u), F.lit(1 / p[1]))
    if name == "cauchy":
        return p[0] + p[1] * F.tan(F.lit(math.pi) * (u - 0.5))
    if name == "triangular":  # least, mode, largest
        a, c, b = p
        return F.when(u < (c - a) / (b - a), a + F.sqrt(u * (b - a) * (c - a))).otherwise(b - F.sqrt((1 - u) * (b - a) * (b - c)))
    if name == "uniform":
        return p[0] + (p[1] - p[0]) * u
    if name == "dirac":
        return F.lit(p[0]) + 0 * u
    if name == "int":  # both ends included
        return (F.lit(int(p[0])) + F.floor(u * (int(p[1]) - int(p[0]) + 1))).cast("long")
    raise ValueError(name)


def variates(name: str, u: list[Column], *p: float) -> Column:
    """Random variates that take several uniforms: normal and lognormal (mean, deviation) two, chi2 (degrees)
    two for each degree, symmetric (least, largest) two, beta (whole a, b) a + b - 1, string one a letter."""
    normal = lambda a, b: F.sqrt(-2 * F.log(1 - a)) * F.cos(F.lit(2 * math.pi) * b)
    if name == "normal":
        return p[0] + p[1] * normal(*u[:2])
    if name == "lognormal":
        return F.exp(p[0] + p[1] * normal(*u[:2]))
    if name == "chi2":
        return sum((F.pow(normal(u[2 * i], u[2 * i + 1]), F.lit(2.0)) for i in range(int(p[0]))), F.lit(0.0))
    if name == "symmetric":
        return p[0] + (p[1] - p[0]) * (u[0] + u[1]) / 2
    if name == "beta":
        return F.get(F.array_sort(F.array(*u[: int(p[0] + p[1]) - 1])), F.lit(int(p[0]) - 1))
    if name == "string":
        return F.concat(*[F.chr(97 + F.floor(v * 26)) for v in u])
    return inverse_cdf(name, u[0], *p)


def distinct_items(ratings: DataFrame, item: str) -> DataFrame:
    return ratings.agg(F.countDistinct(item).alias("n"))


def tasks_by_position(df: DataFrame, tasks: int, order: list[str]) -> DataFrame:
    """(.., task, pos): contiguous ranges of nearly equal size, in order; pos counts from 0 in each task."""
    rows = numbered(df, order, "_at")
    n = rows.count()
    base, extra = divmod(n, tasks)
    at = F.col("_at")
    task = F.when(at < extra * (base + 1), F.floor(at / (base + 1))).otherwise(extra + F.floor((at - extra * (base + 1)) / max(1, base))).cast("int")
    first = F.col("task") * base + F.least(F.col("task"), F.lit(extra))
    return rows.withColumn("task", task).withColumn("pos", at - first).drop("_at")


