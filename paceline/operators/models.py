"""Model families of the fit loop.

A model turns a batch of points into summed contributions under the parameters that the points have been
visited with (``sums``, numpy on Arrow batches: one pass, no row state), and totals into new parameters
(``finalise``). The total of a cumulative model is always the sum of every point's last contribution: the
three clustering models differ only in the contribution, R = sum w, X = sum w x, S = sum w x^2. Other
models sum over the visits of a superstep only. ``project`` gives the same as columns, for scoring.

Points with a null x are left out. NaN in a point goes into the sums and the objective: it shows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import vectors as V


@dataclass(frozen=True)
class Params:
    """What the driver holds: centres, variances, weights; or theta; or H; or a network."""

    centres: np.ndarray | None = None
    variances: np.ndarray | None = None
    weights: np.ndarray | None = None
    theta: np.ndarray | None = None
    h: np.ndarray | None = None
    rate: float = 0.0
    step: int = 0


def first_points(points: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k least ids."""
    return np.array([r.x for r in points.where("x is not null").orderBy("id").limit(k).select("x").collect()], dtype=float)


def width(points: DataFrame) -> int:
    first = points.where("x is not null").select(F.size("x").alias("n")).first()
    return first.n if first else 0


class Model:
    """The surface of a model of one's own: ``init``, ``shapes``, ``sums`` and ``finalise``, and hooks around the
    supersteps if wanted. ``memory``: how many of a point's last visits its contribution depends on
    (None: all of them)."""

    cumulative = True
    mean_objective = False
    memory: int | None = 1

    def init(self, points: DataFrame) -> Params:
        raise NotImplementedError

    def shapes(self, p: Params) -> dict[str, tuple[int, ...]]:
        """Names and shapes of the sums; n (points) and o (objective) are always among them."""
        raise NotImplementedError

    def sums(self, x: np.ndarray, ids: np.ndarray, history: list[Params]) -> dict[str, np.ndarray]:
        """The summed last contributions of points that have been visited with ``history``."""
        raise NotImplementedError

    def window(self, x: np.ndarray, ids: np.ndarray, history: list[Params], p: Params, visits: int) -> dict[str, np.ndarray]:
        """What a visit with ``p`` adds to the totals: new less last contribution."""
        new = self.sums(x, ids, [*history, p])
        if not history:
            return new
        old = self.sums(x, ids, history)
        return {c: new[c] - old[c] for c in new}

    def finalise(self, sums: dict, p: Params) -> Params:
        raise NotImplementedError

    def objective(self, sums: dict, p: Params) -> float:
        """Of a superstep, after finalising to ``p``."""
        return float(sums["o"] / max(1.0, float(sums["n"])) if self.mean_objective else sums["o"])

    def project(self, p: Params) -> tuple[Column, Column]:
        """(weights, objective) of a row with column x."""
        raise NotImplementedError

    # hooks, called in the driver
    def task_setup(self, points: DataFrame) -> None: ...
    def superstep_setup(self, superstep: int, p: Params) -> None: ...
    def superstep_cleanup(self, superstep: int, p: Params, objective: float) -> None: ...
    def task_cleanup(self, p: Params) -> None: ...


def numpy_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(n, k); one centre at a time, so that memory stays that of the batch."""
    return np.sqrt(np.stack([np.square(x - c).sum(1) for c in centres], 1)) if len(centres) else np.zeros((len(x), 0))


@dataclass
class KMeans(Model):
    k: int = 2
    start: np.ndarray | None = None

    def init(self, points):
        return Params(centres=self.start if self.start is not None else first_points(points, self.k))

    def shapes(self, p):
        return {"n": (), "o": (), "R": (len(p.centres),), "X": p.centres.shape}

    def weights(self, x, p):
        d = numpy_distances(x, p.centres)
        known = np.where(np.isnan(d), np.inf, d)
        tag = known.argmin(1)
        w = np.zeros_like(d)
        w[np.arange(len(x)), tag] = 1.0
        return w, d[np.arange(len(x)), tag]

    def sums(self, x, ids, history):
        w, o = self.weights(x, history[-1])
        return {"n": float(len(x)), "o": o.sum(), "R": w.sum(0), "X": w.T @ x}

    def distances(self, p: Params) -> Column:
        return F.transform(V.matrix(p.centres), lambda c: V.distance(F.col("x"), c))

    def project(self, p):
        best = V.let(self.distances(p), lambda d: F.struct(F.array_min(d).alias("o"), V.argmin(d).alias("tag")))
        return V.let(best["tag"], lambda t: F.transform(F.sequence(F.lit(0), F.lit(len(p.centres) - 1)), lambda j: F.when(j == t, 1.0).otherwise(0.0))), best["o"]

    def finalise(self, sums, p):
        with np.errstate(all="ignore"):
            R = np.where(sums["R"] == 0, np.nan, sums["R"])
            return replace(p, centres=sums["X"] / R[:, None])


@dataclass
class FuzzyCMeans(KMeans):
    m: float = 1.1

    def init(self, points):
        # no data points, so that no distance is zero
        return Params(centres=self.start if self.start is not None else np.repeat(np.arange(1.0, self.k + 1)[:, None], width(points), 1))

    def weights(self, x, p):
        d, e = numpy_distances(x, p.centres), 2.0 / (self.m - 1.0)
        with np.errstate(all="ignore"):
            least = d.min(1, keepdims=True)
            u = (1.0 / ((d / least) ** e * ((least / d) ** e).sum(1, keepdims=True))) ** self.m
        return u, (u * d * d).sum(1)

    def project(self, p):
        u = V.let(self.distances(p), lambda d: F.struct(d.alias("d"), V.memberships(d, self.m).alias("u")))
        return u["u"], V.let(u, lambda s: V.total(F.zip_with(s["u"], s["d"], lambda a, b: a * b * b)))


@dataclass
class GaussianMixture(Model):
    k: int = 2
    start: np.ndarray | None = None
    mean_objective = True
    memory = None

    def init(self, points):
        c = self.start if self.start is not None else first_points(points, self.k)
        return Params(centres=c, variances=np.ones_like(c), weights=np.full(len(c), 1.0 / max(1, len(c))))

    def shapes(self, p):
        return {"n": (), "o": (), "R": (len(p.centres),), "X": p.centres.shape, "S": p.centres.shape}

    @staticmethod
    def weights(x, p):
        """(responsibilities, log density) of each point."""
        with np.errstate(all="ignore"):
            const = np.log(p.weights) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + np.log(np.where(p.variances > 0, p.variances, np.nan)).sum(1))
            logs = np.stack([const[j] - 0.5 * (np.square(x - c) / v).sum(1) for j, (c, v) in enumerate(zip(p.centres, p.variances))], 1)
            top = logs.max(1, keepdims=True)
            whole = top[:, 0] + np.log(np.exp(logs - np.where(np.isinf(top), 0, top)).sum(1))
            return np.exp(logs - whole[:, None]), whole

    def sums(self, x, ids, history):
        w, o = np.zeros((len(x), len(history[-1].centres))), np.zeros(len(x))
        # a point of zero total density keeps the contribution of its visit before
        left = np.arange(len(x))
        for p in reversed(history):
            if not len(left):
                break
            r, whole = self.weights(x[left], p)
            dense = np.exp(whole) != 0
            w[left[dense]], o[left[dense]] = r[dense], whole[dense]
            left = left[~dense]
        return {"n": float(len(x)), "o": o.sum(), "R": w.sum(0), "X": w.T @ x, "S": w.T @ (x * x)}

    def project(self, p):
        logs = F.array(*[F.lit(float(math.log(w)) if w > 0 else float("-inf")) + V.log_density(F.col("x"), c, v) for c, v, w in zip(p.centres, p.variances, p.weights)])
        both = V.let(logs, lambda v: F.struct(v.alias("logs"), V.log_sum_exp(v).alias("whole")))
        # a point of zero total density keeps its last contribution: nulls say so
        weights = V.let(both, lambda b: F.when(F.exp(b["whole"]) != 0, F.transform(b["logs"], lambda v: F.exp(v - b["whole"]))))
        return weights, V.let(both, lambda b: F.when(F.exp(b["whole"]) != 0, b["whole"]))

    def finalise(self, sums, p):
        with np.errstate(all="ignore"):
            R = np.where(sums["R"] == 0, np.nan, sums["R"])
            mean = sums["X"] / R[:, None]
            return replace(p, centres=mean, variances=sums["S"] / R[:, None] - mean**2, weights=sums["R"] / max(1.0, sums["n"]))


def log_likelihood_delta(now: Column, before: Column) -> Column:
    """What a point adds to the log-likelihood: its log density less the one of its visit before, if that was finite."""
    return F.when(before.isNull() | (before == float("-inf")), now).otherwise(now - before)


@dataclass
class LogisticRegression(Model):
    """Features and label: x with the label last, no intercept."""

    rate: float = 0.001
    init_theta: float = 0.0
    cumulative = False

    def init(self, points):
        return Params(theta=np.full(max(0, width(points) - 1), self.init_theta))

    def shapes(self, p):
        return {"n": (), "o": (), "R": p.theta.shape}

    def window(self, x, ids, history, p, visits):
        features, y = x[:, :-1], x[:, -1]
        with np.errstate(all="ignore"):
            prob = 1.0 / (1.0 + np.exp(-(features @ p.theta)))
            loss = -(np.where(y == 0, 0.0, y * np.log(prob)) + np.where(y == 1, 0.0, (1 - y) * np.log(1 - prob)))
        return {"n": float(visits * len(x)), "o": visits * loss.sum(), "R": visits * ((prob - y) @ features)}

    def columns(self, p: Params) -> dict[str, Column] | None:
        """The sums as plain columns for few features: one generated loop in the JVM. Column n is the visits."""
        if len(p.theta) > 64:
            return None
        x = [F.get("x", F.lit(i)) for i in range(len(p.theta) + 1)]
        y, z = x[-1], sum((v * F.lit(float(t)) for v, t in zip(x, p.theta)), F.lit(0.0))
        prob = V.sigmoid(z)
        return {"n": F.sum("n").cast("double"), "o": F.sum(V.log_loss(prob, y) * F.col("n"))} | {f"R{i}": F.sum((prob - y) * v * F.col("n")) for i, v in enumerate(x[:-1])}

    def project(self, p):
        features, y = F.slice("x", 1, len(p.theta)), F.element_at("x", -1)
        prob = V.sigmoid(V.dot(features, V.vector(p.theta)))
        return V.let(F.struct(features.alias("f"), (prob - y).alias("e")), lambda b: F.transform(b["f"], lambda v: b["e"] * v)), V.let(prob, lambda q: V.log_loss(q, y))

    def finalise(self, sums, p):
        return replace(p, theta=p.theta - self.rate * sums["R"] / sums["n"]) if sums["n"] else p


# ---- non-negative factorisation: V (rows id, x) is about W H


def nmf_factors(ids: np.ndarray, rank: int) -> np.ndarray:
    """The first factors of rows, from a deterministic expression of the id."""
    return 0.1 + np.mod(ids[:, None] * 7 + np.arange(1, rank + 1) * 3, 11) / 10.0


@dataclass
class NMF(Model):
    """Row factors move by the rule with each visit's H; H moves at the barrier. The row factors follow from the
    id and the Hs that a row was visited with, so they are recomputed, never stored: S visits cost S small
    steps a row. ``multiplicative``: zero denominators leave a factor as it is; else gradient steps,
    row factors by rate (V H' - W H H'), H by rate W'(V - W H)."""

    h: np.ndarray = None
    rate: float = 5e-8
    multiplicative: bool = False
    cumulative = False
    memory = None

    def init(self, points):
        return Params(h=self.h)

    def shapes(self, p):
        r, m = p.h.shape
        return {"n": (), "o": (), "A": (r, m), "B": (r, r)}

    def factors(self, x: np.ndarray, ids: np.ndarray, history: list[Params]) -> np.ndarray:
        w = nmf_factors(ids, len(self.h))
        for p in history:
            num, den = x @ p.h.T, w @ (p.h @ p.h.T)
            w = w * np.divide(num, den, out=np.ones_like(num), where=den != 0) if self.multiplicative else w + self.rate * (num - den)
        return w

    def window(self, x, ids, history, p, visits):
        w = self.factors(x, ids, [*history, *[p] * visits])
        return {"n": float(len(x)), "o": np.square(x).sum(), "A": w.T @ x, "B": w.T @ w}

    def finalise(self, sums, p):
        if self.multiplicative:
            den = sums["B"] @ p.h
            return replace(p, h=p.h * np.divide(sums["A"], den, out=np.ones_like(den), where=den != 0))
        return replace(p, h=p.h + self.rate * (sums["A"] - sums["B"] @ p.h))

    def objective(self, sums, p):
        """Squared error with the new H, from the same sums: |V|^2 - 2 <W'V, H> + <W'W, H H'>."""
        return float(sums["o"] - 2 * (sums["A"] * p.h).sum() + (sums["B"] * (p.h @ p.h.T)).sum())


def nmf_loss(points: DataFrame, h: np.ndarray) -> float:
    """Squared error of the first factors."""
    w = F.transform(F.sequence(F.lit(1), F.lit(len(h))), lambda r: 0.1 + F.pmod(F.col("id") * 7 + r * 3, F.lit(11)) / 10.0)
    fit = V.let(w, lambda w: V.times_matrix(w, h.T))
    return points.agg(F.sum(V.squared_distance(F.col("x"), fit)).alias("l")).first().l or 0.0
