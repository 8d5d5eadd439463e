"""Fits against numpy twins, and their invariants."""

import numpy as np
import pytest

from paceline.operators import models
from paceline.operators.prep import tasks_by_position
from paceline.plans import loop
from paceline.plans.lineage import store


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1, (40, 3)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>")
    return x, store(tasks_by_position(df, 4, ["id"]))


def objectives(df, model, sync=None, steps=4):
    return [h["objective"] for h in loop.fit(df, model, loop.FitConfig(steps, sync or loop.Concurrent())).history]


def test_kmeans_twin(data):
    x, df = data
    c, want = x[:3].copy(), []
    for _ in range(4):
        d = np.sqrt(((x[:, None] - c) ** 2).sum(2))
        want.append(d.min(1).sum())
        c = np.array([x[d.argmin(1) == j].mean(0) for j in range(3)])
    assert objectives(df, models.KMeans(3)) == pytest.approx(want)


def test_fcm_twin(data):
    x, df = data
    c, want = np.repeat(np.arange(1.0, 4)[:, None], 3, 1), []
    for _ in range(3):
        d = np.sqrt(((x[:, None] - c) ** 2).sum(2))
        u = (1 / ((d[:, :, None] / d[:, None, :]) ** (2 / (1.1 - 1))).sum(2)) ** 1.1
        want.append((u * d * d).sum())
        c = (u[:, :, None] * x[:, None]).sum(0) / u.sum(0)[:, None]
    assert objectives(df, models.FuzzyCMeans(3), steps=3) == pytest.approx(want)


@pytest.mark.parametrize("model", [models.KMeans(3), models.FuzzyCMeans(3), models.GaussianMixture(3)], ids=["kmeans", "fcm", "gmm"])
def test_whole_windows_equal_concurrent(data, model):
    _, df = data
    want = objectives(df, model, steps=3)
    assert objectives(df, model, loop.Block(1), 3) == pytest.approx(want)
    assert objectives(df, model, loop.Flexible(1.0, [30.0] * 4), 3) == pytest.approx(want)


def test_flexible_twin_with_straggler(data):
    x, df = data
    sync = loop.Flexible(10.0, [2.0, 2.0, 2.0, 2.0], idle_ms=500, idle_tasks=1)
    q = sync.quotas()
    assert q == [10, 20, 20, 20]
    c, tag, dist, cur, want = x[:3].copy(), None, None, [0] * 4, []
    for s in range(4):
        d = np.sqrt(((x[:, None] - c) ** 2).sum(2))
        if s == 0:
            tag, dist = d.argmin(1), d.min(1)
        else:
            for t in range(4):
                at = 30 * t + (cur[t] + np.arange(q[t])) % 30
                tag[at], dist[at] = d.argmin(1)[at], d.min(1)[at]
                cur[t] = (cur[t] + q[t]) % 30
        want.append(dist.sum())
        c = np.array([x[tag == j].mean(0) for j in range(3)])
    assert objectives(df, models.KMeans(3), sync) == pytest.approx(want)


def test_empty_centre_is_nan_and_never_wins(data):
    _, df = data
    start = np.array([[0.0] * 3, [1000.0] * 3])
    r = loop.fit(df, models.KMeans(2, start), loop.FitConfig(2))
    assert np.isnan(r.params.centres[1]).all() and np.isfinite(r.history[1]["objective"])


def test_gmm_point_without_density_keeps_its_contribution(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [1e6])], "id long, x array<double>")
    r = loop.fit(df, models.GaussianMixture(2), loop.FitConfig(1))
    assert r.params.weights.sum() == pytest.approx(2 / 3)


def test_nmf_loss_falls(spark):
    rows = [(i, [float((i * j) % 5 + 1) for j in range(6)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    h = np.random.default_rng(0).random((2, 6)) + 0.1
    losses = objectives(df, models.NMF(h, multiplicative=True))
    assert all(a >= b for a, b in zip(losses, losses[1:]))
    losses = objectives(df, models.NMF(h, rate=1e-4), steps=3)
    assert losses[0] > losses[-1]


def test_dynamic_checkpoints_get_their_costs(data, monkeypatch):
    _, df = data
    seen = []

    class Seen(loop.Checkpoints):
        def due(self, superstep, archive_s=0.0, recovery_s=0.0):
            seen.append((archive_s, recovery_s))
            return super().due(superstep, archive_s, recovery_s)

    clock = iter(range(10**6))
    monkeypatch.setattr(loop.time, "monotonic", lambda: float(next(clock)))
    loop.fit(df, models.KMeans(3), loop.FitConfig(4, loop.Block(1), checkpoint=Seen(1, "dynamic")))
    assert seen == [(0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (1.0, 0.0)]
