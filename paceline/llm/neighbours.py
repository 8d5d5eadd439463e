"""The k most similar other ids of every id: a robust-pruned graph in each shard.

Vectors are scattered to shards (see ``shards``). In a shard, exact copies are collapsed to one
vector with its ids; a graph over the distinct vectors is built and searched from each of them (see
``graph``), and the distances of what the search met are computed again exactly and rounded to
``DECIMALS`` decimals. A query that visited other shards is finished by ranking the answers of all of
them. For pairs, ids as near as the k-th all count, copies included; if the k-th distance fills the
whole beam with ties, the query is compared with its whole shard instead.

``nearest`` has no radius that bounds the visits. There every vector is searched at home first; then, if
the ball of its k-th distance found reaches into other shards, in the graphs of the ``VISITS`` nearest of
those, and the answers are ranked together. It gives k neighbours to every id (ties to the least ids
met), so a group of copies costs k rows an id and is searched once.

Rows without an id or with an incomplete vector are left out; a repeated id counts once. With fewer
than k other ids all of them are neighbours. A radius limits the neighbours to that distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.llm import graph
from paceline.llm.shards import DIMENSIONS, by_leaf, complete, matrix, sampled_tree, scatter
from paceline.plans.lineage import store

DECIMALS = 6
#: Rows in a shard: a constant, so shards grow in number with the data, not in size.
LEAF_ROWS = 50_000
CHUNK = 1 << 20

SURE, CLOSED, PENDING = 0, 1, 2

#: Other shards that a vector is searched in at most, the nearest first.
VISITS = 8
#: Visitors of one shard in one task.
SLICE = 200_000
#: Members of a shard that visitors are compared with to enter its graph.
PIVOTS = 1024


def collapse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct vector, the number of the distinct vector of each row)."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
    return first, inverse


def _exact(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = u[a] - u[b]
    return np.round(np.einsum("...k,...k->...", diff, diff), DECIMALS)


def _near(u: np.ndarray, mult: np.ndarray, k: int, radius: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, squared distance) between distinct vectors: of each one the others that are as
    near as the k-th other id, within the radius."""
    n = len(u)
    limit = np.round(radius * radius, DECIMALS) if np.isfinite(radius) else np.inf
    y = (u - u.mean(0)).astype(np.float32)
    # float32 distances may be off by a little; what is just beyond is met, too, and sorted out below
    slack = 1e-5 * float((y * y).sum(1).max(initial=0)) + 1e-3
    edges, pool = graph.build(y, None if np.isinf(radius) else float(np.sqrt(radius * radius + slack)))
    most = np.inf if np.isinf(radius) else limit + slack
    out = []
    linked = np.flatnonzero((pool[:, 0] >= 0) & (mult <= k))  # k copies leave no room for others
    for lo in range(0, len(linked), graph.BLOCK):
        me = linked[lo : lo + graph.BLOCK]
        ids, _ = graph.beam_search(y, edges, y[me], pool[me], beam, 3, 4 if np.isfinite(radius) else 8, most)
        ok = (ids >= 0) & (ids != me[:, None])
        d = np.where(ok, _exact(u, np.repeat(me[:, None], beam, 1), ids), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        count = np.cumsum(np.where(np.isfinite(d), mult[ids], 0), axis=1) + (mult[me] - 1)[:, None]
        full = count >= k
        kth = np.where(full.any(1), d[np.arange(len(me)), full.argmax(1)], np.inf)
        take = np.isfinite(d) & (d <= np.minimum(kth, limit)[:, None])
        tied = (ids[:, -2] >= 0) & (d[:, -2] <= kth) & np.isfinite(kth) & (d[:, -2] <= limit)
        for i in np.flatnonzero(tied):
            every = _exact(u, np.full(n, me[i]), np.arange(n))
            every[me[i]] = np.inf
            at = np.argsort(every, kind="stable")
            enough = np.searchsorted(np.cumsum(mult[at]) + mult[me[i]] - 1, k)
            near = np.flatnonzero(every <= min(limit, every[at[min(enough, n - 1)]]))
            out.append((np.full(len(near), me[i]), near, every[near]))
        take[tied] = False
        r, c = np.nonzero(take)
        out.append((me[r], ids[r, c].astype(np.int64), d[r, c]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64 if i < 2 else float) for i in range(3))


def _expand(q: np.ndarray, c: np.ndarray, d: np.ndarray, start: np.ndarray, mult: np.ndarray, member: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of distinct vectors as pairs of their ids, in bounded chunks."""
    size = mult[q] * mult[c]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
        s, qq, cc = size[lo:hi], q[lo:hi], c[lo:hi]
        total = int(s.sum())
        for begin in range(0, total, CHUNK):
            at = np.arange(begin, min(total, begin + CHUNK))
            pair = np.searchsorted(np.cumsum(s), at, side="right")
            inside = at - (np.cumsum(s) - s)[pair]
            yield member[start[qq[pair]] + inside // mult[cc[pair]]], member[start[cc[pair]] + inside % mult[cc[pair]]], d[lo:hi][pair]
        lo = hi


def _shard(table: pa.Table, key: str, dims: list[str], k: int, radius: float, beam: int) -> Iterator[pa.RecordBatch]:
    ids = table.column(key).to_numpy()
    home, is_open = (table.column(c).to_numpy() for c in ("home", "open"))
    _, once = np.unique(ids, return_index=True)
    ids, closed = ids[once], (home & ~is_open)[once]
    x = matrix(table, dims)[once]
    first, inverse = collapse(x)
    mult = np.bincount(inverse, minlength=len(first))
    start = np.cumsum(mult) - mult
    member = np.argsort(inverse, kind="stable")  # row numbers by distinct vector
    u = x[first]
    q, c, d = _near(u, mult, k, radius, beam)
    own = np.flatnonzero(mult > 1)
    q, c, d = np.concatenate([q, own]), np.concatenate([c, own]), np.concatenate([d, np.zeros(len(own))])
    # both ends closed: the pair is final, and named from one side only
    n = len(first)
    key_of = np.minimum(q, c) * n + np.maximum(q, c)
    named = np.argsort(key_of, kind="stable")
    same = np.flatnonzero(key_of[named][1:] == key_of[named][:-1])
    both = np.zeros(len(q), bool)
    both[named[same + 1]] = True
    sure_vec = np.ones(len(first), bool)
    np.logical_and.at(sure_vec, inverse, closed)
    keep = ~(both & sure_vec[q] & sure_vec[c])
    q, c, d = q[keep], c[keep], d[keep]
    for a, b, dd in _expand(q, c, d, start, mult, member):
        other = a != b
        a, b, dd = a[other], b[other], dd[other]
        kind = np.where(closed[a], np.where(closed[b], SURE, CLOSED), PENDING).astype(np.int8)
        # copies name each pair from both sides
        twin = (inverse[a] == inverse[b]) & (a > b) & (kind == SURE)
        a, b, dd, kind = a[~twin], b[~twin], dd[~twin], kind[~twin]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(dd), pa.array(kind)], names=["q", "n", "d2", "kind"])


def _search(df: DataFrame, k: int, radius: float, key: str, dims: list[str], beam: int, leaf_rows: int) -> DataFrame:
    rows = complete(df, key, dims)
    tree = sampled_tree(rows, leaf_rows, key, dims)
    spread = scatter(rows, tree, radius, k, key, dims)

    def run(table: pa.Table) -> pa.Table:
        parts = list(_shard(table, key, dims, k, radius, beam))
        schema = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("d2", pa.float64()), ("kind", pa.int8())])
        return pa.Table.from_batches(parts, schema)

    return store(by_leaf(spread, tree).applyInArrow(run, "q long, n long, d2 double, kind byte"))


def _finished(found: DataFrame, k: int) -> DataFrame:
    """The pending answers of all shards, ranked."""
    pending = found.where(F.col("kind") == PENDING).select("q", "n", "d2").distinct()
    return pending.withColumn("r", F.rank().over(W.partitionBy("q").orderBy("d2"))).where(F.col("r") <= k).drop("r")


def _ranked(q: np.ndarray, c: np.ndarray, d: np.ndarray, top: np.ndarray, many: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of n queries, ids, distances): the k + 1 nearest ids of each query from pairs (query, vector, squared
    distance); top[c, : many[c]] are the least ids of a vector."""
    times = many[c]
    row = np.repeat(np.arange(len(q)), times)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    ids, qq, dd = top[c[row], inside], q[row], d[row]
    order = np.lexsort((ids, dd, qq))
    ids, qq, dd = ids[order], qq[order], dd[order]
    keep = np.arange(len(qq)) - np.searchsorted(qq, qq) <= k
    counts = np.bincount(qq[keep], minlength=n)
    return np.concatenate([[0], np.cumsum(counts)]), ids[keep], dd[keep]


def _lists(offsets: np.ndarray, ids: np.ndarray, d: np.ndarray) -> pa.Array:
    pairs = pa.StructArray.from_arrays([pa.array(d), pa.array(ids)], ["d2", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)


def _beams(u: np.ndarray, v: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, exact squared distance) of the vectors ``ids`` (-1 pads) that each query row of v met."""
    q, col = np.nonzero(ids >= 0)
    c = ids[q, col].astype(np.int64)
    diff = v[q] - u[c]
    return q, c, np.round(np.einsum("ij,ij->i", diff, diff), DECIMALS)


def _at_home(leaf: int, table: pa.Table, key: str, dims: list[str], k: int, beam: int) -> pa.Table:
    """A row for each id of a shard: its vector's number, the k + 1 nearest ids met there and the k-th distance; the
    first row of a vector also has the vector, its graph edges and its k + 1 least ids."""
    ids, once = np.unique(table.column(key).to_numpy(), return_index=True)
    x = matrix(table, dims)[once]
    first, of = collapse(x)
    u, n = x[first], len(first)
    member = np.argsort(of, kind="stable")  # ids ascend inside a vector
    mult = np.bincount(of, minlength=n)
    start = np.cumsum(mult) - mult
    many = np.minimum(mult, k + 1)
    top = ids[member[np.minimum(start[:, None] + np.arange(k + 1), len(ids) - 1)]]
    y = (u - u.mean(0)).astype(np.float32)
    edges, pool = graph.build(y)
    q, c, d = [np.arange(n)], [np.arange(n)], [np.zeros(n)]
    linked = np.flatnonzero((pool[:, 0] >= 0) & (mult <= k))  # k copies leave no room for others
    for lo in range(0, len(linked), graph.BLOCK):
        me = linked[lo : lo + graph.BLOCK]
        met, _ = graph.beam_search(y, edges, y[me], pool[me], beam, 3, beam // 2)
        met[met == me[:, None]] = -1
        a, b, e = _beams(u, u[me], met)
        q.append(me[a]), c.append(b), d.append(e)
    offsets, near, dist = _ranked(*(np.concatenate(v) for v in (q, c, d)), top, many, n, k)
    full = np.diff(offsets) == k + 1
    kth = np.full(n, np.inf)
    kth[full] = dist[offsets[1:][full] - 1]
    whole = _lists(offsets, near, dist)
    lead = np.zeros(len(ids), bool)
    lead[member[start]] = True
    once_only = lambda a: a.take(pa.array(of, mask=~lead))
    width = edges.shape[1]
    columns = {"leaf": np.full(len(ids), leaf, np.int32), "slot": of.astype(np.int32), "id": ids, "first": lead, "kth": kth[of], "near": whole.take(pa.array(of))}
    columns |= {c: once_only(pa.array(u[:, i])) for i, c in enumerate(dims)}
    columns["edges"] = once_only(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(edges.ravel())))
    columns["top"] = once_only(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(top[np.arange(k + 1) < many[:, None]])))
    return pa.table(columns)


def _as_visitors(members: pa.Table, visitors: pa.Table, dims: list[str], k: int, beam: int) -> pa.Table:
    """(home, slot, near): what visitors from other shards meet in the graph of this one, within their distance."""
    if not members.num_rows or not visitors.num_rows:
        return pa.table({"home": pa.array([], pa.int32()), "slot": pa.array([], pa.int32()), "near": _lists(np.zeros(1), np.zeros(0, np.int64), np.zeros(0))})
    members = members.sort_by("slot")
    u, v, n = matrix(members, dims), matrix(visitors, dims), members.num_rows
    edges = members.column("edges").combine_chunks().flatten().to_numpy().reshape(n, -1).astype(np.int32)
    lists = members.column("top").combine_chunks()
    many = lists.value_lengths().to_numpy().astype(np.int64)
    top = np.zeros((n, k + 1), np.int64)
    top[np.arange(k + 1) < many[:, None]] = lists.flatten().to_numpy()
    mid = u.mean(0)
    y, z = (u - mid).astype(np.float32), (v - mid).astype(np.float32)
    pivot = np.random.default_rng(1).permutation(n)[:PIVOTS].astype(np.int32)
    p, kth, q, c, d = y[pivot], visitors.column("kth").to_numpy(), [], [], []
    for lo in range(0, len(z), graph.BLOCK):
        some = z[lo : lo + graph.BLOCK]
        rough = (p * p).sum(1)[None] - 2 * some @ p.T
        seeds = min(len(pivot), beam) // 2 or 1
        begin = pivot[np.argpartition(rough, seeds - 1, axis=1)[:, :seeds]]
        met, _ = graph.beam_search(y, edges, some, begin, beam, 3, beam // 2)
        a, b, e = _beams(u, v[lo : lo + graph.BLOCK], met)
        near = e <= kth[lo + a]
        q.append(lo + a[near]), c.append(b[near]), d.append(e[near])
    offsets, ids, dist = _ranked(*(np.concatenate(a) for a in (q, c, d)), top, many, len(v), k)
    some = np.flatnonzero(np.diff(offsets))
    return pa.table({"home": visitors.column("home").combine_chunks(), "slot": visitors.column("slot").combine_chunks(), "near": _lists(offsets, ids, dist)}).take(pa.array(some))


def nearest(df: DataFrame, k: int = 5, key: str = "sample_id", dims: list[str] = DIMENSIONS, beam: int = 40, leaf_rows: int = LEAF_ROWS, visits: int = VISITS) -> DataFrame:
    """(q, n, d2): of every id its k nearest others (all others if they are fewer)."""
    rows = complete(df, key, dims)
    tree = sampled_tree(rows, leaf_rows, key, dims)
    spread = scatter(rows, tree, 0.0, None, key, dims).where("home")
    vector, lists = ", ".join(f"`{c}` double" for c in dims), "near array<struct<d2:double,n:long>>"
    schema = f"leaf int, slot int, id long, first boolean, kth double, {lists}, {vector}, edges array<int>, top array<long>"
    shared = df.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample
    number = lambda g: int(np.flatnonzero(shared.value.names == g[0].as_py())[0])
    local = store(by_leaf(spread, tree).applyInArrow(lambda g, t: _at_home(number(g), t, key, dims, k, beam), schema))

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            x, home = matrix(b, dims), b.column("home").to_numpy()
            row, leaf, gap = tree.gaps(x, np.sqrt(b.column("kth").to_numpy()))
            away = leaf != home[row]
            row, leaf, gap = row[away], leaf[away], gap[away]
            order = np.lexsort((leaf, gap, row))
            order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < visits]
            out = b.take(pa.array(row[order]))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[order].astype(np.int32)), *out.columns], names=["leaf", *out.schema.names])

    vectors = local.where("first")
    away = store(vectors.select(F.col("leaf").alias("home"), "slot", "kth", *dims).mapInArrow(elsewhere, f"leaf int, home int, slot int, kth double, {vector}"))
    # a shard with many visitors is searched in slices, each with its graph: one count for each shard
    slices = {r.leaf: -(-r["count"] // SLICE) for r in away.groupBy("leaf").count().collect()}
    parts = F.get(F.array(*[F.lit(slices.get(i, 1)) for i in range(tree.leaves)]), F.col("leaf"))
    visitors = away.withColumn("part", F.pmod(F.xxhash64("home", "slot"), parts).cast("int"))
    members = vectors.select("leaf", "slot", *dims, "edges", "top").withColumn("part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    found = members.groupBy("leaf", "part").cogroup(visitors.groupBy("leaf", "part")).applyInArrow(lambda a, b: _as_visitors(a, b, dims, k, beam), f"home int, slot int, {lists}")
    more = found.groupBy(F.col("home").alias("leaf"), "slot").agg(F.flatten(F.collect_list("near")).alias("more"))  # one list of each shard visited
    own = local.select("leaf", "slot", "id", "near").join(more, ["leaf", "slot"], "left")
    both = F.array_sort(F.array_distinct(F.concat("near", F.coalesce("more", F.slice("near", 1, 0)))))
    best = F.slice(F.filter(both, lambda x: x["n"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("q"), F.explode(best).alias("e")).select("q", "e.n", "e.d2")


def nearest_pairs(df: DataFrame, k: int = 5, radius: float = float("inf"), key: str = "sample_id", dims: list[str] = DIMENSIONS, beam: int = 14, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(a, b), a < b: the pairs of which at least one is among the k nearest of the other, once each."""
    found = _search(df, k, radius, key, dims, beam, leaf_rows)
    sure = found.where(F.col("kind") == SURE).select(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b"))
    rest = found.where(F.col("kind") == CLOSED).select("q", "n").unionByName(_finished(found, k).select("q", "n"))
    return sure.unionByName(rest.select(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b")).distinct())
