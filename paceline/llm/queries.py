"""Queries of the training-data operators (names pN_...) and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import bpe, clusters, diversity, mixing, neighbours, sampling, splitting
from paceline.llm.shards import DIMENSIONS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(_table(spark, sf_dir, "samples"), 500).select("sample_id", "position")


def p1_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample kept after the first half of the pieces, brought up to date with the other half."""
    df = _table(spark, sf_dir, "samples")
    half = df.agg(F.max("piece_no")).first()[0] or 0
    first = F.coalesce(F.col("piece_no") <= half // 2, F.lit(False))
    return sampling.updated(sampling.sample(df.where(first), 500), df.where(~first), 500).select("sample_id", "position")


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's size; whether its positions are 0, 1, .. and its ids are ids of the table, each once."""
    got = p1_sample(spark, sf_dir).join(_table(spark, sf_dir, "samples").groupBy("sample_id").agg(F.lit(True).alias("known")), "sample_id", "left")
    in_order = F.coalesce((F.min("position") == 0) & (F.max("position") == F.count("*") - 1), F.lit(True))
    drawn = (F.count_distinct("sample_id") == F.count("*")) & (F.count("known") == F.count("*"))
    return got.agg(F.count("*").alias("n"), in_order.alias("in_order"), drawn.alias("drawn"))


def p1_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every id in the random order that p1_sample takes the first 500 of."""
    return sampling.positions(_table(spark, sf_dir, "samples")).select("sample_id", "position")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(_table(spark, sf_dir, "samples"), 1.0, 3).select("sample_id", "cluster_id")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described(_table(spark, sf_dir, "samples"), 1.0, 3)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.nearest_pairs(_table(spark, sf_dir, "samples"), 5, 1.0)
    return pairs.select(F.col("a").alias("sample_id_a"), F.col("b").alias("sample_id_b"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(_table(spark, sf_dir, "samples"), 5)
    return found.select(F.col("q").alias("sample_id"), F.col("n").alias("neighbour_id"), F.col("d2").alias("squared_distance"))


def p4_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.varied(_table(spark, sf_dir, "samples"), 200)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids equal the text: all of them."""
    coded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    same = bpe.decode(F.col("ids")) == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", same.alias("same"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the listed sources have; a scarce source stays at its max_repeats."""
    return mixing.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"), total_tokens=mixing.SOURCES)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_mixture(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source stays within its repeats, and either meets its target or is held at its repeats (or
    another one is, and what it lacks is shared out)."""
    s = p7_shares(spark, sf_dir)
    full = F.col("repeats") >= F.col("max_repeats")
    within = (F.col("repeats") <= F.col("max_repeats")) & (full | (F.col("share") >= F.col("target_share") - 0.005) | (F.col("tokens") == 0))
    return s.select("source", "target_share", "max_repeats", within.alias("within"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, sf_dir, "documents")).where("piece_no = 1").select("doc_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.with_text(splitting.split_oversized(_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p1_sample, p1_updated, p1_layout, p1_bounds, p2_found, p2_clusters, p3_found, p3_neighbours, p4_varied, p6_ids, p6_round_trip, p7_mixture, p7_shares, p7_totals, p8_found, p8_pieces)}

_OK = " AND ".join(f"isfinite({c})" for c in DIMENSIONS)
_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in DIMENSIONS)
#: Links between complete vectors, found among those whose first dimensions lie in neighbouring cells; then least labels spread along them.
_LINKS = f"""s AS (SELECT sample_id, {", ".join(f"any_value({c}) AS {c}" for c in DIMENSIONS)} FROM samples WHERE sample_id IS NOT NULL AND {_OK} GROUP BY sample_id),
cells AS (SELECT *, floor(dimension_1)::INT AS g FROM s), near AS (SELECT *, unnest([g - 1, g, g + 1]) AS h FROM cells),
e AS MATERIALIZED (SELECT a.sample_id AS x, b.sample_id AS y FROM cells a JOIN near b ON a.g = b.h AND a.sample_id <> b.sample_id WHERE round({_D2}, 6) <= 1)"""

SQL = {
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p2_found": f"""WITH RECURSIVE {_LINKS}, c(id, root) USING KEY (id) AS (SELECT sample_id, sample_id FROM s UNION SELECT e.x, min(c.root) FROM c JOIN e ON e.y = c.id JOIN recurring.c AS o ON o.id = e.x WHERE c.root < o.root GROUP BY e.x),
n AS (SELECT root FROM c GROUP BY root HAVING count(*) >= 3) SELECT c.id AS sample_id, c.root AS cluster_id FROM c JOIN n ON n.root = c.root""",
    "p1_bounds": "SELECT least(500, count(DISTINCT sample_id)) AS n, true AS in_order, true AS drawn FROM samples",
    "p7_totals": "SELECT source, target_share, max_repeats, true AS within FROM mix_targets",
}
