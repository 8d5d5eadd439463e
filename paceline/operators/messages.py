"""Messages between vertices: routing, combining, pulling, block metadata, active sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators.partitioning import task_of

UPDATE, SKIP, MSG_DEPEND = "update", "skip", "msg_depend"


def pushed(messages: DataFrame, routes: list[tuple[int, int]], destination: str) -> DataFrame:
    """``messages`` with the task of their destination, by the (task, least id) ranges; null destinations go nowhere."""
    return task_of(messages.where(F.col(destination).isNotNull()), routes, destination)


def pulled(vertices: DataFrame, edges: DataFrame, value: str, key: str = "id", source: str = "src", destination: str = "dst", how: str = "sum") -> DataFrame:
    """(key, value): every vertex pulls the values of the vertices with an edge to it, combined. Edges are combined
    by source and destination before they meet the values, so that repeated edges cost one row."""
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    once = edges.where(F.col(source).isNotNull() & F.col(destination).isNotNull()).groupBy(source, destination).agg(F.count("*").alias("_n"))
    sent = once.join(vertices.select(F.col(key).alias(source), F.col(value).alias("_v")), source)
    weighted = F.col("_v") * F.col("_n") if how == "sum" else F.col("_v")
    return sent.groupBy(F.col(destination).alias(key)).agg(agg(weighted).alias("value"))


def block_metadata(vertices: DataFrame, edges: DataFrame, block: int, key: str = "id", source: str = "src") -> DataFrame:
    """(block, vertices, min_id, max_id, edges, fragments): blocks of ``block`` consecutive ids; a fragment is the
    edges of one vertex."""
    of = lambda c: F.floor(F.col(c) / block).alias("block")
    v = vertices.groupBy(of(key)).agg(F.count("*").alias("vertices"), F.min(key).alias("min_id"), F.max(key).alias("max_id"))
    each = edges.where(F.col(source).isNotNull()).groupBy(source).agg(F.count("*").alias("_n"))
    e = each.groupBy(of(source)).agg(F.sum("_n").alias("edges"), F.count("*").alias("fragments"))
    return v.join(e, "block", "left").fillna(0, ["edges", "fragments"])


def active(vertices: DataFrame, rule: str, messages: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The vertices that a superstep updates: all, none, or those with a message."""
    if rule == UPDATE:
        return vertices
    if rule == SKIP:
        return vertices.limit(0)
    if rule == MSG_DEPEND and messages is not None:
        return vertices.join(messages.select(key).distinct(), key, "left_semi")
    raise ValueError(rule)
