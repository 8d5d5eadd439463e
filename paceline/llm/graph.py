"""A robust-pruned directed neighbour graph over the vectors of one shard, in numpy.

Points are first placed in the small buckets of a few randomised median trees and linked to the
nearest ones there. Then, in passes over blocks of points, a greedy beam search from each point proposes neighbours, relaxed distance pruning keeps a diverse few of them
(a candidate is dropped if an edge already kept is ``1 / alpha`` times nearer to it than the point
is), and the reversed edges are added and pruned in the same way. Searches are beam searches; the
whole block advances at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096


def _distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    diff = x[ids] - q[:, None, :]
    return np.einsum("ijk,ijk->ij", diff, diff)


def _shortest(ids: np.ndarray, d: np.ndarray, width: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``width`` nearest of each row in ascending order, each id once."""
    order = np.argsort(d, axis=1, kind="stable")[:, :width]
    return tuple(np.take_along_axis(a, order, 1) for a in (ids, d, *more))


def beam_search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, start: np.ndarray, width: int, expand: int, hops: int, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest points met for each query row, (ids, squared distances); ids of -1 are padding.
    ``start``: the ids to begin with. A query stops when the whole beam has been expanded. Points beyond
    the squared distance ``most`` are not met."""
    n = len(q)
    ids = np.full((n, width), -1, np.int32)
    d = np.full((n, width), np.inf, np.float32)
    first = np.sort(start, axis=1)
    fd = _distances(x, q, first)
    fd[:, 1:][first[:, 1:] == first[:, :-1]] = np.inf
    fd[(first < 0) | (fd > most)] = np.inf
    first, fd = _shortest(first, fd, width)
    ids[:, : first.shape[1]], d[:, : first.shape[1]] = first, fd
    ids[np.isinf(d)] = -1
    done = ids < 0
    live = np.arange(n)
    for _ in range(hops):
        open_ = ~done[live]
        some = open_.any(1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        # the first ``expand`` open entries of each row (entries are in order)
        turn = np.cumsum(open_, axis=1, dtype=np.int16)
        pick = open_ & (turn <= expand)
        row, col = np.nonzero(pick)
        slot = turn[row, col] - 1
        chosen = np.full((len(live), expand), -1, np.int32)
        chosen[row, slot] = ids[live[row], col]
        done[live[row], col] = True
        new = edges[chosen].reshape(len(live), -1)
        new[np.repeat(chosen < 0, edges.shape[1], axis=1)] = -1
        new.sort(axis=1)
        bad = new < 0
        bad[:, 1:] |= new[:, 1:] == new[:, :-1]
        mine = ids[live]
        nd = _distances(x, q[live], new)
        # only what is nearer than the end of the beam can enter it
        bad |= nd >= np.minimum(d[live, -1], most)[:, None]
        r, c = np.nonzero(~bad)
        known = (mine[r] == new[r, c][:, None]).any(1)
        bad[r[known], c[known]] = True
        nd[bad] = np.inf
        enter = int((~bad).sum(1).max()) if bad.size else 0
        if not enter:
            continue
        if enter < new.shape[1]:
            best = np.argpartition(nd, enter - 1, axis=1)[:, :enter]
            new, nd = np.take_along_axis(new, best, 1), np.take_along_axis(nd, best, 1)
        a, b, e = _shortest(np.concatenate([mine, new], 1), np.concatenate([d[live], nd], 1), width, np.concatenate([done[live], np.isinf(nd)], 1))
        a[np.isinf(b)] = -1
        ids[live], d[live], done[live] = a, b, e
    return ids, d


def robust_prune(x: np.ndarray, cand: np.ndarray, d: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of each row: at most ``degree`` of the candidates, which come in ascending distance ``d``
    (-1 pads), none of them much nearer to an earlier edge than to the point."""
    n, m = cand.shape
    v = x[cand]
    sq = np.einsum("ijk,ijk->ij", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    hides = alpha * alpha * between <= d[:, None, :]
    alive = cand >= 0
    keep = np.zeros_like(alive)
    room = np.full(n, degree)
    for j in range(m):
        take = alive[:, j] & (room > 0)
        keep[:, j] = take
        room -= take
        alive &= ~(take[:, None] & hides[:, j])
    out = np.full((n, degree), -1, np.int32)
    r, c = np.nonzero(keep)
    out[r, (np.cumsum(keep, axis=1)[r, c] - 1)] = cand[r, c]
    return out


def _reversed(edges: np.ndarray, most: int) -> np.ndarray:
    """For each point up to ``most`` points that link to it, the nearest ranks first."""
    n, degree = edges.shape
    dst = edges.T.ravel()  # by rank, so that a stable sort keeps near edges first
    src = np.tile(np.arange(n, dtype=np.int32), degree)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    out = np.full((n, most), -1, np.int32)
    fit = rank < most
    out[dst[fit], rank[fit]] = src[fit]
    return out


def _buckets(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """The points in buckets of ``size`` by median splits along wide dimensions, (buckets, size); -1 pads."""
    n, d = x.shape
    levels = max(0, int(np.ceil(np.log2(max(1, n) / size))))
    idx = np.full((1, size << levels), -1, np.int32)
    idx[0, :n] = rng.permutation(n)
    for _ in range(levels):
        some = idx[:, : min(idx.shape[1], 64)]
        wide = x[some].std(axis=1)
        # the widest of a random half of the dimensions
        f = np.argmax(np.where(rng.random(wide.shape) < 0.5, wide, -1), axis=1)
        key = x[idx, f[:, None]]
        key[idx < 0] = np.inf
        half = idx.shape[1] // 2
        real = (idx >= 0).sum(1)
        if (real == idx.shape[1]).all():
            idx = np.take_along_axis(idx, np.argpartition(key, half, axis=1), 1).reshape(-1, half)
        else:  # halve the points, not the padding
            order = np.take_along_axis(idx, np.argsort(key, axis=1), 1)
            left = (real + 1) // 2
            out = np.full((len(idx), 2, half), -1, np.int32)
            at = np.arange(half)
            out[:, 0] = np.where(at < left[:, None], order[:, :half], -1)
            right = left[:, None] + at
            out[:, 1] = np.where(right < real[:, None], np.take_along_axis(order, np.minimum(right, order.shape[1] - 1), 1), -1)
            idx = out.reshape(-1, half)
    return idx


def _first_candidates(x: np.ndarray, trees: int, size: int, keep: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of each point in its buckets of all trees, in ascending order."""
    n = len(x)
    ids, ds = np.full((n, trees * keep), -1, np.int32), np.full((n, trees * keep), np.inf, np.float32)
    for t in range(trees):
        bucket = _buckets(x, size, rng)
        for lo in range(0, len(bucket), 1024):
            b = bucket[lo : lo + 1024]
            v = x[b]
            sq = np.einsum("ijk,ijk->ij", v, v)
            d = np.matmul(v, v.transpose(0, 2, 1))
            d *= -2
            d += sq[:, :, None]
            d += sq[:, None, :]
            d[np.broadcast_to((b < 0)[:, None, :], d.shape)] = np.inf
            d[:, np.arange(size), np.arange(size)] = np.inf
            best = np.argpartition(d, keep - 1, axis=2)[:, :, :keep]
            bd = np.take_along_axis(d, best, 2)
            to = np.take_along_axis(np.broadcast_to(b[:, None, :], d.shape), best, 2)
            real = b >= 0
            ids[b[real], t * keep : (t + 1) * keep] = to[real]
            ds[b[real], t * keep : (t + 1) * keep] = bd[real]
    return ids, np.maximum(ds, 0)


def _distinct(ids: np.ndarray, d: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest distinct ids of each row in ascending order; -1 pads."""
    order = np.argsort(ids, axis=1)
    ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
    bad = ids < 0
    bad[:, 1:] |= ids[:, 1:] == ids[:, :-1]
    d = np.where(bad, np.inf, d)
    ids, d = _shortest(ids, d, width)
    ids[np.isinf(d)] = -1
    return ids, d


def build(x: np.ndarray, radius: float | None = None, degree: int = 10, beam: int = 14, alpha: float = 1.2, passes: int | None = None, trees: int = 4, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(edges, pool) over the distinct float32 vectors ``x``: the graph (n, degree) and the nearest
    points met for each point; -1 pads. With a ``radius`` nothing farther away is linked, for nothing
    farther away is asked for; then one pass is enough."""
    n = len(x)
    none = np.full((n, degree), -1, np.int32)
    if n < 2:
        return none, none
    rng = np.random.default_rng(seed)
    most = np.inf if radius is None else radius * radius * 1.001 + 1e-3
    size = 32
    ids, d = _first_candidates(x, trees, size, min(8, size), rng)
    pool = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf, np.float32)
    for lo in range(0, n, BLOCK):
        me = slice(lo, lo + BLOCK)
        d[me][d[me] > most] = np.inf
        pool[me], dist[me] = _distinct(np.where(np.isinf(d[me]), -1, ids[me]), d[me], beam)
    del ids, d
    edges = pool[:, :degree].copy()
    for _ in range(passes or (2 if radius is None else 1)):
        linked = np.flatnonzero(pool[:, 0] >= 0)
        new = none.copy()
        for lo in range(0, len(linked), BLOCK):
            me = linked[lo : lo + BLOCK]
            ids, d = beam_search(x, edges, x[me], pool[me], beam + 1, 3, 6, most)
            d = np.where(ids == me[:, None], np.inf, d)
            ids, d = _shortest(np.where(ids == me[:, None], -1, ids), d, beam)
            pool[me], dist[me] = ids, d
            new[me] = robust_prune(x, ids, d, degree, alpha)
        edges = _with_reversed(x, new, degree, alpha)
    return edges, pool


def _with_reversed(x: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    both = np.concatenate([new, _reversed(new, degree)], 1)
    edges = new.copy()
    more = np.flatnonzero(both[:, degree] >= 0)
    for lo in range(0, len(more), BLOCK):
        me = more[lo : lo + BLOCK]
        c, d = _distinct(both[me], _distances(x, x[me], both[me]), 2 * degree)
        few = (c >= 0).sum(1) <= degree  # all of them fit
        edges[me[few]] = c[few, :degree]
        if not few.all():
            edges[me[~few]] = robust_prune(x, c[~few], d[~few], degree, alpha)
    return edges
