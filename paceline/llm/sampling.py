"""A uniform sample of fixed size from data of unknown length, by a random-permutation layout.

Every record id has a pseudorandom 64-bit place (a seeded hash). Its leading part is the random
bucket, the rest the shuffle inside the bucket; a repeated delivery has the same place, so an id
counts once however often its row arrives. The first k positions of this layout are the sample.
Positions follow from a prefix sum over the counts of distinct ids in the buckets, so only the
buckets that the first k positions reach into are ever laid out: their number is first guessed from
the row count and widened until they hold k ids. Null ids are left out; with fewer than k ids all
of them are drawn.

Places do not depend on other records. So a sample can be kept up while pieces arrive: the sample of
(sample + new piece) is the sample of all pieces (``updated``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of the layout (a power of two), and the rows that a guess aims at for each wanted position.
BUCKETS = 1 << 20
SPARE = 4


def place(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def bucket(key: str, seed: int) -> Column:
    return F.shiftrightunsigned(place(key, seed), 64 - 20)


def layout(df: DataFrame, key: str, seed: int, first_buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket, place) of the distinct ids in the first buckets; equal rows are combined before the shuffle."""
    rows = df.select(F.col(key), bucket(key, seed).alias("bucket")).where(F.col(key).isNotNull() & (F.col("bucket") < first_buckets))
    return rows.distinct().withColumn("place", place(key, seed + 1))


def positions(df: DataFrame, key: str = "sample_id", seed: int = 1) -> DataFrame:
    """(key, bucket, position): the whole layout, a position for every distinct id: counts of the buckets, their
    prefix sums (first over groups of buckets, then inside a group), and the order inside each bucket."""
    ids = layout(df, key, seed)
    counts = ids.groupBy("bucket").count().withColumn("part", F.shiftrightunsigned("bucket", 10))
    parts = counts.groupBy("part").agg(F.sum("count").alias("n"))  # at most 1,024 rows
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    starts = counts.join(F.broadcast(parts), "part").select("bucket", (F.col("before") + F.sum("count").over(W.partitionBy("part").orderBy("bucket")) - F.col("count")).alias("before"))
    inside = F.row_number().over(W.partitionBy("bucket").orderBy("place", key)) - 1
    return ids.withColumn("inside", inside).join(starts, "bucket").select(key, "bucket", (F.col("before") + F.col("inside")).alias("position"))


def sample(df: DataFrame, k: int = 500, key: str = "sample_id", seed: int = 1) -> DataFrame:
    """(key, bucket, position): k ids, each equally likely, with their positions 0..k-1."""
    n = df.count()
    wide = BUCKETS if n <= SPARE * k else min(BUCKETS, max(1, -(-SPARE * k * BUCKETS // n)))
    while True:
        ids = layout(df, key, seed, wide)
        # at most as many rows as positions are asked for: counts of the first buckets in order
        counts = ids.groupBy("bucket").count().orderBy("bucket").limit(k).collect()
        if sum(r["count"] for r in counts) >= k or wide >= BUCKETS:
            break
        wide = min(BUCKETS, 4 * wide)
    before, starts = 0, []
    for r in counts:
        if before < k:
            starts.append((r.bucket, before))
        before += r["count"]
    last = starts[-1][0] if starts else -1
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "bucket long, before long"))  # at most k rows
    inside = F.row_number().over(W.partitionBy("bucket").orderBy("place", key)) - 1
    placed = ids.where(F.col("bucket") <= last).withColumn("inside", inside).join(offsets, "bucket")
    return placed.select(key, "bucket", (F.col("before") + F.col("inside")).alias("position")).where(F.col("position") < k)


def updated(kept: DataFrame, piece: DataFrame, k: int = 500, key: str = "sample_id", seed: int = 1) -> DataFrame:
    """The sample of everything so far, from the sample kept and a new piece."""
    return sample(kept.select(key).unionByName(piece.select(key)), k, key, seed)
