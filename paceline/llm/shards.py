"""Shards of similar vectors: a median-split tree over a bounded sample, applied to every row.

The tree is fitted on at most ``SAMPLE`` rows, chosen by hash over the whole table. Every complete
vector goes to the shard of its leaf (its home). A vector whose ball of radius r reaches the box of
another leaf visits that shard too, so that each home has company from across its borders. In a
region denser than the sample's k-th neighbours show, r shrinks to the distance of the k-th sampled
neighbour, which bounds the true one; a dense group cut by many leaves therefore causes few visits.

A vector is complete when all its dimensions are present and finite; other rows are left out.
Repeated rows stay repeated here; a shard sees all rows of an id, for they have the same vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the rows that the tree is fitted on.
SAMPLE = 1 << 16
#: A leaf of the tree keeps at least so many sampled rows.
LEAST_SAMPLE = 16

DIMENSIONS = [f"dimension_{i}" for i in range(1, 13)]


def complete(df: DataFrame, key: str = "sample_id", dims: list[str] = DIMENSIONS) -> DataFrame:
    """(key, dims) of the rows with an id and a complete vector."""
    infinite = F.lit(float("inf"))
    ok = F.col(key).isNotNull()
    for c in dims:
        ok &= F.abs(c) < infinite  # false for NaN and infinities, null for null
    return df.select(key, *dims).where(ok)


@dataclass
class Tree:
    dim: np.ndarray  # of each node, -1 at leaves
    at: np.ndarray
    low: np.ndarray  # child with x[dim] <= at; at leaves the number of the leaf
    high: np.ndarray
    box_low: np.ndarray  # of each leaf
    box_high: np.ndarray
    sample: list[np.ndarray]  # sampled vectors of each leaf
    names: np.ndarray | None = None  # the leaf column's value for each leaf (see ``partition_keys``)

    @property
    def leaves(self) -> int:
        return len(self.box_low)

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int32)
        rows = np.arange(len(x))
        while len(rows):
            here = node[rows]
            inner = self.dim[here] >= 0
            rows, here = rows[inner], here[inner]
            right = x[rows, self.dim[here]] > self.at[here]
            node[rows] = np.where(right, self.high[here], self.low[here])
        return self.low[node]

    def visits(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box is within the radius of the row."""
        return self.gaps(x, radius)[:2]

    def gaps(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, squared distance to its box) of all leaves whose box is within the radius of the row."""
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int32)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            leaf = self.dim[node] < 0
            if leaf.any():
                r, n = rows[leaf], self.low[node[leaf]]
                gap = np.maximum(np.maximum(self.box_low[n] - x[r], x[r] - self.box_high[n]), 0)
                off = (gap * gap).sum(1)
                near = off <= radius[r] ** 2 * (1 + 1e-9)
                out.append((r[near], n[near], off[near]))
                rows, node = rows[~leaf], node[~leaf]
            off = x[rows, self.dim[node]] - self.at[node]
            low, high = off <= radius[rows], off >= -radius[rows]
            rows, node = np.concatenate([rows[low], rows[high]]), np.concatenate([self.low[node[low]], self.high[node[high]]])
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0))


def fit_tree(sample: np.ndarray, leaves: int) -> Tree:
    """Leaves of about equal numbers of sampled rows. A node is cut in its widest dimensions' emptiest place
    near the median."""
    dim, at, low, high, boxes_low, boxes_high, kept = [], [], [], [], [], [], []
    d = sample.shape[1]

    def grow(rows: np.ndarray, want: int, lo: np.ndarray, hi: np.ndarray) -> int:
        me = len(dim)
        for column in (dim, at, low, high):
            column.append(-1)
        x = sample[rows]
        best = None
        if want > 1 and len(rows) >= 2 * LEAST_SAMPLE:
            span = max(2, len(rows) // 64)
            for f in np.argsort(-x.std(axis=0))[:4]:
                v = np.sort(x[:, f])
                a, b = int(len(v) * 0.35), int(len(v) * 0.65)
                gaps = v[a + span : b + span] - v[a:b]
                if len(gaps) and gaps.max() > 0 and (best is None or gaps.max() > best[0]):
                    i = a + int(gaps.argmax())
                    inner = np.diff(v[i : i + span + 1])
                    j = i + int(inner.argmax())
                    best = (gaps.max(), f, (v[j] + v[j + 1]) / 2)
        right = x[:, best[1]] > best[2] if best else np.zeros(len(rows), bool)
        if not right.any() or right.all():
            low[me] = len(boxes_low)
            boxes_low.append(lo)
            boxes_high.append(hi)
            kept.append(x)
            return me
        _, f, cut = best
        part = max(1, min(want - 1, round(want * (1 - right.mean()))))
        hi_low, lo_high = hi.copy(), lo.copy()
        hi_low[f] = lo_high[f] = cut
        dim[me], at[me] = f, cut
        low[me] = grow(rows[~right], part, lo, hi_low)
        high[me] = grow(rows[right], want - part, lo_high, hi)
        return me

    grow(np.arange(len(sample)), leaves, np.full(d, -np.inf), np.full(d, np.inf))
    return Tree(np.array(dim, np.int32), np.array(at, float), np.array(low, np.int32), np.array(high, np.int32), np.array(boxes_low), np.array(boxes_high), kept)


def partition_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions the least number that Spark's hash partitioning puts there."""
    most = 16 * n
    while True:
        number = F.col("id").cast("int")
        rows = spark.range(most).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("p")).agg(F.min(number).alias("k")).collect()
        if len(rows) == n:
            return np.array([r.k for r in sorted(rows, key=lambda r: r.p)], np.int32)
        most *= 2


def by_leaf(spread: DataFrame, tree: Tree, in_task: int = 1):
    """The rows of each leaf as a group; ``in_task`` (1, 2, 4 or 8) leaves in a task at most."""
    return spread.repartition(_rounded(tree.leaves) // in_task, "leaf").groupBy("leaf")


def _rounded(leaves: int) -> int:
    """To a multiple of 8, so that keys which are apart among so many partitions share one of half as many by twos."""
    return -(-leaves // 8) * 8


def sampled_tree(df: DataFrame, leaf_rows: int, key: str, dims: list[str], seed: int = 11) -> Tree:
    """The tree for the complete vectors ``df``: fitted on a hash sample of at most about SAMPLE rows."""
    n = max(1, df.count())
    share = min(1.0, SAMPLE / n)
    chosen = df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(key).alias("_key"), *dims).limit(2 * SAMPLE)
    rows = chosen.toArrow()
    x = np.stack([rows[c].to_numpy() for c in dims], 1) if rows.num_rows else np.zeros((0, len(dims)))
    tree = fit_tree(x, max(1, -(-n // leaf_rows)))
    if rows.num_rows:
        # one row for each id, so that repeated deliveries of an id don't count as neighbours in _reach
        x = x[np.unique(rows["_key"].to_numpy(), return_index=True)[1]]
        home = tree.home(x)
        tree.sample = [x[home == leaf] for leaf in range(tree.leaves)]
    tree.names = partition_keys(df.sparkSession, _rounded(tree.leaves))[: tree.leaves]
    return tree


def matrix(batch: pa.RecordBatch | pa.Table, dims: list[str]) -> np.ndarray:
    # + 0.0 makes a negative zero positive, so that equal vectors have equal bytes
    return np.stack([batch.column(c).to_numpy() if isinstance(batch, pa.Table) else batch.column(c).to_numpy(zero_copy_only=False) for c in dims], 1) + 0.0


def _reach(x: np.ndarray, home: np.ndarray, tree: Tree, k: int, radius: float) -> np.ndarray:
    """For each row the radius, or the distance of its k-th other neighbour in the home's sample if smaller."""
    out = np.full(len(x), radius)
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    for rows in np.split(order, cuts):
        s = tree.sample[home[rows[0]]] if len(rows) else np.zeros((0, 0))
        if len(s) <= k:
            continue
        mid = s.mean(0)
        a, b = (x[rows] - mid).astype(np.float32), (s - mid).astype(np.float32)
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        slack = 1e-5 * ((a * a).sum(1) + (b * b).sum(1).max()) + 1e-6
        dense = np.flatnonzero((d <= radius * radius).sum(1) > k) if np.isfinite(radius) else np.arange(len(rows))
        if len(dense):
            # the (k + 1)-th, for the row itself may be in the sample
            kth = np.partition(d[dense], k, axis=1)[:, k] + slack[dense]
            out[rows[dense]] = np.minimum(radius, np.sqrt(np.maximum(kth, 0)))
    return out


def scatter(df: DataFrame, tree: Tree, radius: float, k: int | None, key: str, dims: list[str], lower_only: bool = False) -> DataFrame:
    """(leaf, home, open, key, dims): every row at home, and at the shards that it visits (``leaf`` is a name). ``open`` rows
    visit somewhere. With ``k`` the radius shrinks to the k-th sampled neighbour. With ``lower_only``
    rows visit leaves below their own only: enough where one side of a link suffices."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tree)  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, dims)
            home = tree.home(x)
            reach = _reach(x, home, tree, k, radius) if k and tree.leaves > 1 else np.full(len(x), radius)
            row, leaf = tree.visits(x, reach) if tree.leaves > 1 else (np.zeros(0, int), np.zeros(0, np.int32))
            away = leaf < home[row] if lower_only else leaf != home[row]
            row, leaf = row[away], leaf[away]
            is_open = np.zeros(len(x), bool)
            is_open[row] = True
            every = np.concatenate([np.arange(len(x)), row])
            rows = batch.select([key, *dims]).take(pa.array(every))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree.names[np.concatenate([home, leaf])]), pa.array(np.arange(len(every)) < len(x)), pa.array(is_open[every]), *rows.columns],
                names=["leaf", "home", "open", key, *dims],
            )

    schema = f"leaf int, home boolean, open boolean, `{key}` long, " + ", ".join(f"`{c}` double" for c in dims)
    return df.select(F.col(key).cast("long").alias(key), *(F.col(c).cast("double").alias(c) for c in dims)).mapInArrow(run, schema)
