"""A varied subset of given size: cluster features, Ward agglomeration, nearest records.

Every partition summarises its vectors in a bounded number of cluster features (count, centroid; the
bound is ``ENTRIES``, or twice the groups wanted if that is more, and it is doubled if fewer entries
than groups are left): a vector joins the nearest feature within the threshold, else it starts one; when
there are too many, the threshold grows and near features are absorbed into each other. The summaries are merged sixteen
at a time, level by level, until one is left: the leaf entries of the tree. They are agglomerated by Ward linkage,
every entry with equal weight, so that a dense group of almost equal points, which lies in one or
few entries, counts like any other place; the tree is cut at k groups. For each group centre the nearest record is
returned; no record stands for two groups.

Rows without an id or with an incomplete vector are left out. With k or fewer distinct vectors each
of them gives one id (the least). Ties go to the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.llm.shards import DIMENSIONS, complete, matrix
from paceline.plans.lineage import store

#: Bound of the entries in a summary for few groups.
ENTRIES = 1024
FAN_IN = 16
#: Candidates kept for each centre at first.
SPARE = 8


class Features:
    """At most ``most`` cluster features of a stream of vectors."""

    def __init__(self, most: int, threshold: float = 0.0):
        self.most, self.threshold = most, threshold
        self.n, self.sum = np.zeros(0), None

    def add(self, x: np.ndarray, n: np.ndarray | None = None) -> None:
        n = np.ones(len(x)) if n is None else n
        for lo in range(0, len(x), 4096):
            self._block(x[lo : lo + 4096], n[lo : lo + 4096])

    def _block(self, x: np.ndarray, n: np.ndarray) -> None:
        if self.sum is None:
            self.sum = np.zeros((0, x.shape[1]))
        while len(x):
            if len(self.n):
                at, d = self._nearest(x, self.sum / self.n[:, None])
                near = d <= self.threshold
                np.add.at(self.n, at[near], n[near])
                np.add.at(self.sum, at[near], x[near] * n[near, None])
                x, n = x[~near], n[~near]
            if not len(x):
                return
            # leaders of the first few that are left; the others are tried again
            head = min(len(x), 256)
            d = _squares(x[:head], x[:head]) <= self.threshold**2
            leader = np.zeros(head, bool)
            free = np.ones(head, bool)
            for i in range(head):
                if free[i]:
                    leader[i] = True
                    free &= ~d[i]
                    free[i] = False
            self.n = np.concatenate([self.n, n[:head][leader]])
            self.sum = np.concatenate([self.sum, x[:head][leader] * n[:head][leader, None]])
            rest = np.concatenate([np.flatnonzero(~leader), np.arange(head, len(x))])
            x, n = x[rest], n[rest]
            if len(self.n) > self.most:
                self._grow()

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _squares(x, c)
        at = d.argmin(1)
        return at, np.sqrt(np.maximum(d[np.arange(len(x)), at], 0))

    def _grow(self) -> None:
        """Raises the threshold until at most three quarters of the entries are left."""
        while len(self.n) > self.most * 3 // 4:
            c = self.sum / self.n[:, None]
            d = _squares(c, c)
            np.fill_diagonal(d, np.inf)
            self.threshold = max(1.1 * self.threshold, float(np.sqrt(np.quantile(d.min(1), 0.2))), 1e-9)
            near = d <= self.threshold**2
            to, free = np.arange(len(c)), np.ones(len(c), bool)
            for i in np.argsort(-self.n, kind="stable"):
                if free[i]:
                    free[i] = False
                    mine = near[i] & free
                    to[mine] = i
                    free &= ~mine
            heads, of = np.unique(to, return_inverse=True)
            total, sums = np.zeros(len(heads)), np.zeros((len(heads), c.shape[1]))
            np.add.at(total, of, self.n)
            np.add.at(sums, of, self.sum)
            self.n, self.sum = total, sums

    def table(self, part: int) -> pa.Table:
        d = 0 if self.sum is None else self.sum.shape[1]
        c = self.sum / self.n[:, None] if d else np.zeros((0, 0))
        return pa.table({"part": np.full(len(self.n), part, np.int64), "threshold": np.full(len(self.n), self.threshold), "n": self.n, "c": pa.array(list(c), pa.list_(pa.float64()))})


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    mid = c.mean(0) if len(c) else 0.0
    a, b = (x - mid).astype(np.float32), (c - mid).astype(np.float32)
    out = a @ b.T
    out *= -2
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None]
    return np.maximum(out, 0)


def leaf_entries(rows: DataFrame, dims: list[str], entries: int = ENTRIES) -> DataFrame:
    """(part, threshold, n, c): the entries of one summary of all rows."""
    schema = "part long, threshold double, n double, c array<double>"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        f = Features(entries)
        for batch in batches:
            f.add(matrix(batch, dims))
        yield from f.table(TaskContext.get().partitionId()).to_batches()

    def merge(key, table):
        f = Features(entries, max(table.column("threshold").to_pylist()))
        f.add(np.array(table.column("c").to_pylist()), table.column("n").to_numpy())
        return f.table(key[0].as_py())

    out = store(rows.select(*dims).mapInArrow(summarise, schema))
    while out.select("part").distinct().count() > 1:
        out = store(out.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merge, schema))
    return out


def ward(c: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each entry: Ward linkage of entries of equal weight, cut at ``groups``. The least
    cost of each row is kept up, so a merge costs a few rows."""
    n = len(c)
    size, centre, member = np.ones(n), c.astype(float).copy(), [[i] for i in range(n)]
    d = np.zeros((n, n))
    for f in range(c.shape[1]):
        d += np.square(c[:, f][:, None] - c[:, f][None])
    d *= 0.5
    np.fill_diagonal(d, np.inf)
    live = np.ones(n, bool)
    to = d.argmin(1)
    least = d[np.arange(n), to]
    for _ in range(max(0, n - groups)):
        i = int(least.argmin())
        i, j = sorted((i, int(to[i])))
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        member[i] += member[j]
        live[j] = False
        d[j], d[:, j], least[j] = np.inf, np.inf, np.inf
        other = np.flatnonzero(live)
        other = other[other != i]
        cost = size[i] * size[other] / (size[i] + size[other]) * ((centre[other] - centre[i]) ** 2).sum(1)
        d[i, other], d[other, i] = cost, cost
        stale = np.append(other[(to[other] == i) | (to[other] == j)], i)
        to[stale] = d[stale].argmin(1)
        least[stale] = d[stale, to[stale]]
        closer = other[(cost < least[other]) | ((cost == least[other]) & (i < to[other]))]
        to[closer], least[closer] = i, d[closer, i]
    group = np.empty(n, int)
    for g, i in enumerate(np.flatnonzero(live)):
        group[member[i]] = g
    return group


def nearest_records(rows: DataFrame, centres: np.ndarray, keep: int, key: str, dims: list[str]) -> DataFrame:
    """(centre, d, key): the ``keep`` nearest ids of each centre; each partition sends at most that many."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # at most k rows

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        found = {j: {} for j in range(len(c))}
        worst = np.full(len(c), np.inf)
        for batch in batches:
            x, ids = matrix(batch, dims), batch.column(key).to_numpy(zero_copy_only=False)
            ids, once = np.unique(ids, return_index=True)  # all rows of an id agree
            x = x[once]
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                rough = _squares(part, c)
                slack = 1e-5 * float((np.square(part - c.mean(0))).sum(1).max(initial=0) + np.square(c - c.mean(0)).sum(1).max()) + 1e-6
                n = min(len(part), keep)
                # what may be among the ``keep`` nearest, ties and float32 errors included
                far = np.minimum(np.partition(rough, n - 1, axis=0)[n - 1] + slack, worst + slack)
                for j in range(len(c)):
                    rows_ = np.flatnonzero(rough[:, j] <= far[j])
                    if not len(rows_):
                        continue
                    exact = np.round(((part[rows_] - c[j]) ** 2).sum(1), 6)
                    first = np.argsort(exact, kind="stable")[:keep]  # ids ascend: ties go to the least
                    for d, i in zip(exact[first], ids[lo + rows_[first]]):
                        found[j][int(i)] = float(d)
                    if len(found[j]) > keep:
                        found[j] = dict(sorted(found[j].items(), key=lambda x: (x[1], x[0]))[:keep])
                        worst[j] = max(found[j].values())
        out = [(j, d, i) for j, f in found.items() for i, d in f.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.int64())], names=["centre", "d", key])

    sent = rows.select(F.col(key).cast("long").alias(key), *dims).mapInArrow(best, f"centre int, d double, `{key}` long").groupBy("centre", key).agg(F.min("d").alias("d"))
    return sent.withColumn("r", F.row_number().over(W.partitionBy("centre").orderBy("d", key))).where(F.col("r") <= keep).drop("r")


def varied(df: DataFrame, k: int = 200, key: str = "sample_id", dims: list[str] = DIMENSIONS) -> DataFrame:
    """(group, key, d2, entries): k ids, each the nearest record of its group's centre, with its squared
    distance to it and the number of leaf entries in the group."""
    rows = complete(df, key, dims)
    spark = df.sparkSession
    schema = f"`group` int, `{key}` long, d2 double, entries int"
    entries = max(ENTRIES, 2 * k)
    while True:
        leaves = leaf_entries(rows, dims, entries).toArrow()
        if not leaves.num_rows:
            return spark.createDataFrame([], schema)
        # a threshold of zero: every distinct vector is an entry
        if leaves.num_rows >= k or max(leaves.column("threshold").to_pylist()) == 0:
            break
        entries *= 2
    c = np.array(leaves.column("c").to_pylist())
    c = c[np.lexsort(c.T)]
    group = ward(c, k)
    size = np.bincount(group)
    centres = np.stack([c[group == g].mean(0) for g in range(len(size))])
    keep = SPARE
    while True:
        by: dict[int, list] = {}
        got = nearest_records(rows, centres, keep, key, dims).orderBy("centre", "d", key).collect()
        for r in got:
            by.setdefault(r.centre, []).append((r.d, r[key]))
        used, out, short = set(), [], False
        for g in sorted(by, key=lambda g: by[g][0]):
            free = [(d, i) for d, i in by[g] if i not in used]
            if free:
                used.add(free[0][1])
                out.append((int(g), int(free[0][1]), float(free[0][0]), int(size[g])))
            else:
                short |= len(by[g]) == keep
        if not short:
            return spark.createDataFrame(out, schema)
        keep *= 4
