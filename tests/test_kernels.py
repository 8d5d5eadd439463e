import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.functions import grids
from paceline.functions import vectors as V
from paceline.operators import cnn, metrics, partitioning, prep
from paceline.plans import tuning
from paceline.sources import points


def test_grids():
    m = np.arange(1.0, 26).reshape(5, 5)
    full = grids.correlate_full(m, np.ones((3, 3)))
    assert full[0].tolist() == [1, 3, 6, 9, 12, 9, 5] and full[3].tolist() == [33, 69, 108, 117, 126, 87, 45]
    assert grids.mean_pool(np.arange(1.0, 257).reshape(16, 16), 2, 2)[0, 0] == 9.5
    with pytest.raises(ValueError):
        grids.mean_pool(m, 2, 2)
    assert grids.kronecker(m, 2, 2).shape == (10, 10)
    assert grids.rot180(np.array([[1, 2], [3, 4]])).tolist() == [[4, 3], [2, 1]]
    assert grids.sigmoid(0.727855957917715) == pytest.approx(0.6743346010828868)


def test_cnn_forward_and_gradient():
    net = cnn.Network.start()
    c1, _, c2, _, out = cnn.forward(net, np.ones((1, 28, 28)))
    assert c1[0, 0, 0, 0] == pytest.approx(0.7772998611746911) and c2[0, 0, 0, 0] == pytest.approx(0.9970697966733137)
    assert out[0] == pytest.approx(np.full(10, 0.9999303438600047))
    rng = np.random.default_rng(1)
    net = cnn.Network(*[rng.normal(0, 0.1, a.shape) for a in net.arrays()])
    x, y = rng.random((3, 28, 28)), np.array([1, 5, 9])
    g, loss, _ = cnn.changes(net, x, y)
    for layer, at in ((0, (2, 1, 3)), (2, (3, 7, 4, 0)), (4, (5, 2, 1, 1)), (1, (2,)), (3, (4,)), (5, (9,))):
        a = net.arrays()[layer]
        # mean pooling divides by its area, which the expanded errors of the reference's rule do not
        scale = {0: 16, 1: 16, 2: 4, 3: 4}.get(layer, 1)
        a[at] += 1e-6
        up = cnn.changes(net, x, y)[1]
        a[at] -= 1e-6
        assert g[layer][at] / scale == pytest.approx(-(up - loss) / 1e-6, rel=1e-2, abs=1e-6)


def test_split_sizes_and_placement():
    assert partitioning.split_sizes(1000, 4) == [250] * 4
    assert partitioning.split_sizes(1000, 4, 0.5) == [334, 222, 222, 222]
    assert partitioning.split_sizes(1003, 4, 0.9) == [392, 204, 204, 203]
    assert partitioning.split_sizes(10, 1, 0.9) == [10]
    assert partitioning.placement(5, 2) == [0, 0, 0, 1, 1]
    assert partitioning.placement(5, 3, one_on_master=True) == [0, 1, 1, 2, 2]


def test_tuners():
    assert tuning.block_size(4, 1) == 600 and tuning.block_count(10_000, 4, 600) == 4
    c = tuning.Checkpoints(2, "dynamic")
    assert [c.due(s, 1, r) for s, r in ((1, 9), (2, 0), (3, 2), (4, 9), (5, 9))] == [False, False, True, False, True]
    assert tuning.stops(2, 10, 0.5, 1.0, False) and not tuning.stops(2, 10, 0.5, 1.0, True)


def test_parsing_of_odd_lines(spark):
    lines = ["1\t1.5,2", "nokey", "a\tb\tc", "", None, "5\t", "6\t7"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    k, v = points.key_value(F.col("value"))
    got = [tuple(r) for r in df.select(k, v).collect()]
    assert got == [("1", "1.5,2"), ("nokey", ""), ("a", ""), ("", ""), ("", ""), ("5", ""), ("6", "7")]
    x = [r[0] for r in df.select(points.parse_vector(v)).collect()]
    assert x == [[1.5, 2.0], [], [], [], [], [], [7.0]]


def test_text_round_trip_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.5]), (2, [3.0])], "id long, x array<double>")
    points.write_points(df, str(tmp_path / "p"))
    assert sorted(map(tuple, points.read_points(spark, str(tmp_path / "p")).collect())) == [(1, [1.0, 2.5]), (2, [3.0])]
    assert prep.numbered(df.limit(0), ["id"], "n").count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 3.0],)], "x array<double>")
    nan = float("nan")
    d = V.vector([nan, 2.0, 2.0])
    r = df.select(V.distance(F.col("x"), V.vector([4.0, 0.0])), V.argmin(d), V.safe_log(F.lit(0.0)), V.log_loss(F.lit(0.5), F.lit(1.0))).first()
    assert r[0] == 5.0 and r[1] == 1 and r[2] == float("-inf") and r[3] == pytest.approx(0.693147, abs=1e-6)


def test_reports_with_nulls(spark):
    rows = [("j", 1, 0, 5, 1.0, 1, 1, None), ("j", 1, 0, 5, 1.0, 1, 1, None), ("j", 1, 1, None, float("nan"), 1, 3, None), ("j", 2, 0, 7, 0.25, 1, 2, None)]
    df = spark.createDataFrame(rows, "job_id string, superstep int, task_id int, points_read long, task_agg double, run_ms long, sync_ms long, reported_at timestamp")
    got = {r.superstep: (r.objective, r.running, r.progress) for r in metrics.objective_history(df).collect()}
    assert got == {1: (1.0, 1.0, 0.0), 2: (0.25, 1.25, 0.75)}
    assert {r.superstep: r.median for r in metrics.upper_median(metrics.once(df), ["job_id", "superstep"], "sync_ms").collect()} == {1: 3, 2: 2}
