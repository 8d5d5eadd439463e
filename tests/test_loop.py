"""The loop's parts: blocks, migration, recovery, tuners, hooks, network, wall clock."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import cnn, messages, models, partitioning
from paceline.operators.prep import tasks_by_position
from paceline.plans import control, lineage, loop, tuning
from paceline.plans.lineage import store
from paceline.streaming import barrier


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 1, (34, 3)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>")
    return x, store(tasks_by_position(df, 4, ["id"]))


def history(df, model, config):
    return [h["objective"] for h in loop.fit(df, model, config).history]


def windows_twin(x, updates):
    """k-means objectives after each update of the rows in its window."""
    c, tag, dist, out = x[:3].copy(), np.zeros(len(x), int), np.zeros(len(x)), []
    for at in updates:
        d = np.sqrt(((x[:, None] - c) ** 2).sum(2))
        tag[at], dist[at] = d.argmin(1)[at], d.min(1)[at]
        out.append(dist.sum())
        c = np.array([x[tag == j].mean(0) for j in range(3)])
    return out


def test_mini_batches_and_remainder_of_one_task(spark, data):
    x, df = data
    one = df.select(F.lit(0).alias("task"), F.col("id").alias("pos"), "id", "x")
    every = np.arange(len(x))
    batches = [np.arange(lo, min(102, lo + 40)) for lo in (0, 40, 80)]
    want = windows_twin(x, [every, *batches, *batches])
    assert history(one, models.KMeans(3), loop.FitConfig(3, loop.Block(size=40))) == pytest.approx([want[0], want[3], want[6]])
    quarters = [np.arange(lo, min(102, lo + 25)) for lo in range(0, 102, 25)]  # four of 25 and the rest
    assert history(one, models.KMeans(3), loop.FitConfig(2, loop.Block(4, remainder=True))) == pytest.approx([want[0], windows_twin(x, [every, *quarters])[-1]])


def test_cyclic_windows_cover_their_quota():
    for n in (1, 5, 8):
        for c in range(n):
            for q in (1, 3, n, n + 2, 3 * n):
                seen = np.zeros(n, int)
                for lo, hi, v in loop.cyclic([n], [c], [q])[0]:
                    seen[lo:hi] += v
                want = np.zeros(n, int)
                np.add.at(want, (c + np.arange(q)) % n, 1)
                assert seen.tolist() == want.tolist()


def test_resume_after_a_loss(spark, data, tmp_path):
    _, df = data
    sync = loop.Flexible(1.0, [11.0, 7.0, 30.0, 5.0])
    want = history(df, models.GaussianMixture(3), loop.FitConfig(5, sync))
    c = dict(sync=sync, checkpoint=tuning.Checkpoints(2), checkpoint_to=str(tmp_path / "ck"))
    assert history(df, models.GaussianMixture(3), loop.FitConfig(5, fail_at=4, **c)) == pytest.approx(want)
    assert lineage.versions(spark, str(tmp_path / "ck")) == [4]

    class Breaks(models.GaussianMixture):
        def superstep_setup(self, superstep, p):
            if superstep == 3:
                raise RuntimeError("lost")

    states, c["checkpoint_to"] = [], str(tmp_path / "other")
    with pytest.raises(RuntimeError):
        loop.fit(df, Breaks(3), loop.FitConfig(5, on_state=states.append, **c))
    assert states == ["PREP", "LOAD", "RUNNING", "FAILED"]
    r = loop.fit(df, models.GaussianMixture(3), loop.FitConfig(5, resume=True, **c))
    assert [h["objective"] for h in r.history] == pytest.approx(want) and r.states[-1] == "SUCCEEDED"


def test_nothing_is_written_without_checkpoints(spark, data, tmp_path):
    _, df = data
    folder = lineage.checkpoint_dir(spark)
    fs, p = lineage.folder(spark, folder)
    before = fs.getContentSummary(p).getLength()
    loop.fit(df, models.KMeans(3), loop.FitConfig(6, loop.Block(2)))
    assert fs.getContentSummary(p).getLength() == before


def test_last_contributions_sum_to_the_totals_after_migration(spark, data):
    _, df = data
    for model in (models.KMeans(3), models.FuzzyCMeans(3), models.GaussianMixture(3)):
        r = loop.fit(df, model, loop.FitConfig(4, loop.Flexible(1.0, [9.0] * 4), migrate={2: 1, 3: 0}, migrate_chunk=5))
        got = np.array([row.w for row in r.contributions(df).collect()])
        assert got.sum(0) == pytest.approx(r.totals["R"]) and len(got) == 102
        assert sum(r.state.sizes) == 102


def test_moved_points_keep_unique_positions(spark, data):
    _, df = data
    for tasks, sender, chunk in ((4, 1, 5), (16, 0, 3), (7, 3, 100)):
        sizes = [26, 26, 25, 25] + [0] * (tasks - 4)
        out = partitioning.moved(df, sender, sizes, chunk).select("task", "pos").collect()
        ranges = partitioning.moved_ranges([[(0, n, "a")] if n else [] for n in sizes], sender, chunk)
        assert len(set(out)) == 102
        for t, r in enumerate(ranges):
            n = sum(o.task == t for o in out)
            assert (r[-1][1] if r else 0) == n and sorted(o.pos for o in out if o.task == t) == list(range(n))


def test_custom_model_with_hooks(spark, data):
    x, df = data

    class Mean(models.Model):
        """One centre, moved half of the way to the mean."""

        calls = []

        def init(self, points):
            return models.Params(theta=np.zeros(3))

        def shapes(self, p):
            return {"n": (), "o": (), "X": (3,)}

        def sums(self, x, ids, history):
            return {"n": float(len(x)), "o": np.abs(x - history[-1].theta).sum(), "X": x.sum(0)}

        def finalise(self, sums, p):
            return models.Params(theta=(p.theta + sums["X"] / sums["n"]) / 2)

        def superstep_setup(self, superstep, p):
            self.calls.append(superstep)

        def task_cleanup(self, p):
            self.calls.append("end")

    r = loop.fit(df, Mean(), loop.FitConfig(2))
    assert r.params.theta == pytest.approx(0.75 * x.mean(0)) and Mean.calls == [1, 2, "end"]


def test_nmf_blocks_twin(spark):
    rows = [(i, [float((i * j) % 5 + 1) for j in range(6)]) for i in range(30)]
    df = store(tasks_by_position(spark.createDataFrame(rows, "id long, x array<double>"), 2, ["id"]))
    h = np.random.default_rng(0).random((2, 6)) + 0.1
    r = loop.fit(df, models.NMF(h, rate=1e-4), loop.FitConfig(3, loop.Block(3)))
    v, w, g = np.array([x for _, x in rows]), models.nmf_factors(np.arange(30), 2), h.copy()
    for at in [np.arange(30)] + [np.r_[5 * b : 5 * b + 5, 15 + 5 * b : 20 + 5 * b] for b in range(3)] * 2:
        w[at] += 1e-4 * (v[at] @ g.T - w[at] @ (g @ g.T))
        g = g + 1e-4 * w[at].T @ (v[at] - w[at] @ g)
    assert r.params.h == pytest.approx(g)


def test_network_twin_and_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((40, 784)), rng.integers(0, 10, 40)
    rows = [(i, [float(a) for a in v], int(t)) for i, (v, t) in enumerate(zip(x, y))] + [(90, [1.0], 3), (91, [0.5] * 784, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    net, arrays = cnn.train(df, 2)[0], cnn.Network.start().arrays()
    for _ in range(2):
        g = cnn.changes(cnn.Network(*arrays), x.reshape(-1, 28, 28), y)[0]
        arrays = [a + 0.85 * d / 40 for a, d in zip(arrays, g)]
    for a, b in zip(net.arrays(), arrays):
        assert a == pytest.approx(b)
    maps = cnn.train(df, 1, bias_norm="maps")[0]
    assert maps.b1 == pytest.approx(0.85 * cnn.changes(cnn.Network.start(), x.reshape(-1, 28, 28), y)[0][1] / 6)
    tasked = tasks_by_position(cnn.labelled_images(df).select("id"), 2, ["id"]).join(df, "id")
    assert [h["records"] for h in cnn.train(store(tasked), 2, sync=loop.Block(2))[1]] == [40, 40]


def test_nan_shows_in_the_objective_for_few_and_many_sums(spark):
    for d in (1, 200):
        df = spark.createDataFrame([(i, [float(i)] * d) for i in range(8)] + [(8, [float("nan")] * d), (9, None)], "id long, x array<double>")
        r = loop.fit(df, models.KMeans(2), loop.FitConfig(1))
        assert np.isnan(r.history[0]["objective"]) and r.totals["n"] == 9


def test_tuners_by_their_rules():
    t = tuning.IntervalTuner()
    got = [t.step(s, 1000.0, p) for s, p in ((1, 0.0), (2, 100.0), (3, 80.0), (4, 20.0), (5, 10.0))]
    assert got == [500.0, 250.0, 125.0, 187.5, 187.5]
    t = tuning.IntervalTuner(rising=True)
    assert [t.step(s, 80.0, p) for s, p in ((1, 0.0), (2, -9.0), (3, -2.0))] == [40.0, 20.0, 30.0]
    assert [tuning.IntervalTuner().step(s, 8.0, 0.0) for s in (1, 2)] == [4.0, 150.0]  # no progress at once: back
    t = tuning.WindowedTuner()
    got = [t.step(s, 1000.0, p) for s, p in enumerate([0.0, 9.0, 8.0, 7.0, 6.0, 6.0, 5.0, 4.0, 3.0], 1)]
    assert got == [500.0] * 4 + [250.0] * 4 + [125.0]  # 7 + 6 > 0; target 6 - (7 - 6) = 5; 4 + 3 > 5
    b = tuning.BlockTuner()
    assert [b.step(*v) for v in ((4, 1), (4, 1), (4, 1), (9, 9))] == [None, None, 600, 600]


def test_block_tuner_in_a_fit(spark, data):
    _, df = data
    sync = loop.Block(2, tuner=tuning.BlockTuner())
    r = loop.fit(df, models.KMeans(3), loop.FitConfig(5, sync))
    assert r.state.sync.size and r.state.sync.tuner.size == r.state.sync.size and sync.size is None
    assert all(h["points"] == 102 and h["sync_s"] >= 0 for h in r.history)


def test_splits_slots_and_admission(spark):
    assert partitioning.tasks_of_splits([3, 9, 9], 8, 5) == [1, 2, 0, None, None]
    with pytest.raises(ValueError):
        partitioning.tasks_of_splits([1] * 9, 8)
    free = iter([0, 1, 2])
    assert control.admitted(spark, 2, 0.0, 5.0, lambda: next(free)) and not control.admitted(spark, 2, 0.0, 0.0, lambda: 0)
    with pytest.raises(ValueError):
        control.admitted(spark, 10_000)


def test_runner_logs_and_states(spark, tmp_path):
    log, queries = control.logger(str(tmp_path / "log"), 200, 1), {"ok": lambda s, d: s.range(3), "bad": lambda s, d: s.table("none")}
    assert [control.run(spark, queries, n, "", None, log) for n in ("ok", "bad", "ok", "ok", "ok")] == ["SUCCEEDED", "FAILED"] + ["SUCCEEDED"] * 3
    assert len(list(tmp_path.iterdir())) == 2 and all(p.stat().st_size <= 300 for p in tmp_path.iterdir())
    assert control.progress(spark) == []


def test_wall_clock_takes_any_model(spark, data):
    x, df = data
    got = barrier.fit_by_clock(df, models.GaussianMixture(3), 3, 0.02, 2, block=16).collect()
    whole = history(df, models.GaussianMixture(3), loop.FitConfig(1))
    assert len(got) == 6 and sum(r.points for r in got if r.superstep == 1) == 102
    assert {round(r.objective, 6) for r in got if r.superstep == 1} == {round(whole[0], 6)}


def test_pull_with_repeated_edges_and_nulls(spark):
    v = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0)], "id long, v double")
    e = spark.createDataFrame([(1, 3), (1, 3), (2, 3), (None, 3), (2, None), (9, 1)], "src long, dst long")
    assert [tuple(r) for r in messages.pulled(v, e, "v").collect()] == [(3, 25.0)]
    assert [tuple(r) for r in messages.pulled(v, e, "v", how="min").collect()] == [(3, 5.0)]
    with pytest.raises(ValueError):
        messages.active(v, "other")
