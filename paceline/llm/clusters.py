"""Clusters of mutually similar vectors: hash-ordered pivots in rounds, then contraction.

In each shard (see ``shards``) exact copies are collapsed, and the similar vectors (distance at most
``radius``) are found block by block. Vectors are taken in hash order: those with the least hash among
their unclustered similar vectors become pivots and absorb them, in rounds until none is left; members
are then reassigned to the closest pivot. Each pivot's cluster is contracted to one node, and clusters
between which any link remains are merged by the same least-neighbour rule, until none remains. Across
shards the contracted nodes are linked by the vectors that visited, and merged in the same way by
rounds over that (small) graph in Spark. So a result cluster is a set of ids connected by links.

Rows without an id or with an incomplete vector are left out; a repeated id counts once; copies are
always in one cluster; an id without similar ones is a cluster of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.llm.neighbours import DECIMALS, collapse
from paceline.llm.shards import DIMENSIONS, Tree, by_leaf, complete, matrix, sampled_tree, scatter
from paceline.plans.lineage import cut, store

LEAF_ROWS = 4_000
#: Members of a cluster that are ranked in one group.
SLICE = 50_000
#: Rows of one block of the distance matrix.
BLOCK = 512


def links(u: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The similar vectors of each one, itself included, in ascending order: those of i are
    ``to[start[i]:start[i + 1]]``."""
    n = len(u)
    limit = np.round(radius * radius, DECIMALS)
    y = (u - u.mean(0)).astype(np.float32)
    sq = (y * y).sum(1)
    slack = np.float32(2e-5 * sq.max(initial=0) + 1e-5)
    one = np.ones((n, 1), np.float32)
    a, b = np.hstack([-2 * y, one, sq[:, None]]), np.ascontiguousarray(np.hstack([y, sq[:, None], one]).T)
    count, to = [np.zeros(1, np.int64)], []
    for lo in range(0, n, BLOCK):
        d = a[lo : lo + BLOCK] @ b
        at = np.flatnonzero(d <= limit + slack)
        i, j = np.divmod(at, n)
        unsure = np.flatnonzero(d.ravel()[at] >= limit - slack)
        if len(unsure):
            diff = u[lo + i[unsure]] - u[j[unsure]]
            keep = np.ones(len(at), bool)
            keep[unsure] = (np.round((diff * diff).sum(1), DECIMALS) <= limit) | (lo + i[unsure] == j[unsure])
            i, j = i[keep], j[keep]
        count.append(np.bincount(i, minlength=len(d)))
        to.append(j.astype(np.int32))
    return np.cumsum(np.concatenate(count)), np.concatenate(to) if to else np.zeros(0, np.int32)


def pivots(start: np.ndarray, to: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The pivot of each vector; vectors must be in hash order."""
    n = len(u)
    pivot, alive = np.full(n, n, np.int64), np.ones(n, bool)
    while alive.any():
        least = np.minimum.reduceat(np.where(alive[to], to, n), start[:-1])
        chosen = alive & (least == np.arange(n))
        owner = np.minimum.reduceat(np.where(chosen[to], to, n), start[:-1])
        taken = alive & (owner < n)
        pivot[taken] = owner[taken]
        alive &= ~taken
    # the closest of the similar pivots
    is_head = pivot == np.arange(n)
    member = np.repeat(np.arange(n), np.diff(start))[is_head[to]]
    head = to[is_head[to]]
    diff = u[member] - u[head]
    order = np.lexsort((head, np.round((diff * diff).sum(1), DECIMALS), member))
    first = np.concatenate([[True], np.diff(member[order]) > 0])
    pivot[member[order][first]] = head[order][first]
    return pivot


def merged(start: np.ndarray, to: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """A label for each vector, equal for clusters joined by links: contraction to the least neighbour."""
    label = np.arange(len(pivot))
    while True:
        mine = label[pivot]
        least = np.minimum.reduceat(mine[to], start[:-1])
        new = label.copy()
        np.minimum.at(new, mine, least)  # of each label the least one next to it
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new[label], label):
            return mine
        label = new[label]


def _mix(ids: np.ndarray) -> np.ndarray:
    """A fixed hash of the ids, the order of the pivots."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _shard(leaf: int, table: pa.Table, key: str, dims: list[str], radius: float, least: int, tree: Tree) -> pa.Table:
    """(node, id, home, open, pivot, size, final, leaf): the local cluster of each row of a shard, named by
    its least id, with its size. It is final if no row of it is open or visiting; final clusters of
    fewer than ``least`` ids are left out, and so are clusters of visitors of one home only, whose links
    that home has seen itself."""
    ids = table.column(key).to_numpy()
    home, is_open = (table.column(c).to_numpy() for c in ("home", "open"))
    order = np.lexsort((~home, ids))
    order = order[np.concatenate([[True], np.diff(ids[order]) > 0])]
    ids, home, is_open = ids[order], home[order], is_open[order]
    x = matrix(table, dims)[order]
    first, inverse = collapse(x)
    lowest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(lowest, inverse, ids)
    by_hash = np.argsort(_mix(lowest), kind="stable")
    place = np.empty(len(first), np.int64)
    place[by_hash] = np.arange(len(first))
    u = x[first[by_hash]]
    start, to = links(u, radius)
    pivot = pivots(start, to, u)
    label = merged(start, to, pivot)[place[inverse]]
    name, unsure = np.full(len(u), np.iinfo(np.int64).max), np.zeros(len(u), bool)
    np.minimum.at(name, label, ids)
    np.logical_or.at(unsure, label, is_open | ~home)
    size = np.bincount(label, minlength=len(u))
    # the homes met in each cluster: least and largest
    at = np.where(home, leaf, tree.home(x))
    low, high, lived = np.full(len(u), tree.leaves), np.full(len(u), -1), np.zeros(len(u), bool)
    np.minimum.at(low, label, at)
    np.maximum.at(high, label, at)
    np.logical_or.at(lived, label, home)
    keep = np.where(unsure, lived | (low < high), size >= least)[label]
    columns = {"node": name[label], "id": ids, "home": home, "open": is_open, "pivot": lowest[by_hash][pivot[place[inverse]]], "size": size[label], "final": ~unsure[label]}
    return pa.table({c: v[keep] for c, v in columns.items()} | {"leaf": np.full(int(keep.sum()), leaf, np.int32)})


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected set of the edges (a, b), by alternating rounds in which every
    node's larger, then smaller, neighbours are linked to its least one. Hot nodes are pre-aggregated:
    a round takes the minimum over neighbours only."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        new = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if new.join(e, ["a", "b"], "left_anti").isEmpty() and e.join(new, ["a", "b"], "left_anti").isEmpty():
            return new.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        e = new


def clusters(df: DataFrame, radius: float = 1.0, least: int = 1, key: str = "sample_id", dims: list[str] = DIMENSIONS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(key, cluster_id, size, pivot): the cluster of every id, named by its least id, for clusters of
    at least ``least`` ids. ``pivot`` is the least id of the pivot vector that absorbed the id."""
    rows = complete(df, key, dims)
    tree = sampled_tree(rows, leaf_rows, key, dims)
    spread = scatter(rows, tree, radius, None, key, dims, lower_only=True)
    shared = df.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample
    local = store(
        by_leaf(spread, tree, 8).applyInArrow(
            lambda k, t: _shard(int(np.flatnonzero(shared.value.names == k[0].as_py())[0]), t, key, dims, radius, least, shared.value),
            "node long, id long, home boolean, open boolean, pivot long, size long, final boolean, leaf int",
        )
    )
    final = local.where("final").select(F.col("id").alias(key), F.col("node").alias("cluster_id"), "size", "pivot")
    # an id that visits has a node in each shard where it was; its nodes are one cluster
    name = F.struct("node", "leaf")
    unsure = local.where("not final")
    linked = unsure.where("open or not home").groupBy("id").agg(F.min(name).alias("b"), F.collect_set(name).alias("all")).where(F.size("all") > 1)
    edges = linked.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()
    top = roots(edges).select(F.col("node.node").alias("node"), F.col("node.leaf").alias("leaf"), F.col("root"))
    homes = unsure.where("home")
    # groups are pre-aggregated in each shard: one row for each node
    nodes = homes.groupBy("node", "leaf").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    rooted = nodes.join(top, ["node", "leaf"], "left").withColumn("root", F.coalesce("root", name))
    sums = rooted.groupBy("root").agg(F.sum("n").alias("size"), F.min("first").alias("cluster_id")).where(F.col("size") >= least)
    named = rooted.select("node", "leaf", "root").join(sums, "root").drop("root")
    rest = homes.select("node", "leaf", "id", "pivot").join(named, ["node", "leaf"]).select(F.col("id").alias(key), "cluster_id", "size", "pivot")
    return final.unionByName(rest)


def described(df: DataFrame, radius: float = 1.0, typical: int = 3, least: int = 1, key: str = "sample_id", dims: list[str] = DIMENSIONS) -> DataFrame:
    """(cluster_id, size, typical): each cluster with its ``typical`` most typical ids, those of the least mean
    squared distance to all members (which are the nearest to their mean); ties by id."""
    found = clusters(df, radius, least, key, dims)
    x = F.struct(*dims)
    once = complete(df, key, dims).groupBy(key).agg(F.first(x).alias("x"))
    members = store(found.join(once, key).select("cluster_id", "size", F.col(key).alias("id"), "x.*"))
    means = members.groupBy("cluster_id").agg(*(F.avg(c).alias(f"m_{c}") for c in dims))
    off = sum((F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in dims), F.lit(0.0))
    scored = members.join(means, "cluster_id").select("cluster_id", "size", F.round(off, DECIMALS).alias("d"), "id")
    # the best of each hash slice first, so that no cluster is sorted in one task
    for slices in (F.ceil(F.col("size") / SLICE), F.lit(1)):
        w = W.partitionBy("cluster_id", "size", F.pmod(F.xxhash64("id"), slices)).orderBy("d", "id")
        scored = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical).drop("r")
    best = scored.groupBy("cluster_id", "size").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("best"))
    return best.select("cluster_id", "size", F.transform("best", lambda s: s["id"]).alias("typical"))
