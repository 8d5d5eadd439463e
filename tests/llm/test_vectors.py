import numpy as np
import pytest

from paceline.llm import clusters, diversity, neighbours, sampling, shards
from paceline.llm.shards import DIMENSIONS, fit_tree

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 12, (60, 12))
    x = np.concatenate([c + rng.normal(0, 0.12, (rng.integers(1, 40), 12)) for c in centres] + [rng.normal(0, 12, (300, 12))]).round(3)
    x = np.concatenate([x, x[:20], x[:20]])  # copies under other ids
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    bad = [(5000, None, *[1.0] * 11), (5001, NAN, *[1.0] * 11), (5002, *[1.0] * 11, INF), (None, *[1.0] * 12), (3, None, *[0.0] * 11)]
    df = spark.createDataFrame(rows + rows[:50] + bad, "sample_id long, " + ", ".join(f"{c} double" for c in DIMENSIONS))
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), 6)
    np.fill_diagonal(d, np.inf)
    return x, d, df.withColumnsRenamed({}).selectExpr("*", "1 as leaf", "2 as q").repartition(5)


def test_sample(data, spark):
    x, _, df = data
    got = sampling.sample(df, 50).collect()
    assert sorted(r.position for r in got) == list(range(50)) and len({r.sample_id for r in got}) == 50
    assert sampling.sample(df, 10**6).count() == len(x) + 3 and sampling.sample(df.limit(0), 5).count() == 0
    a, b = df.where("sample_id % 2 = 0"), df.where("sample_id % 2 = 1")
    assert {r.sample_id for r in sampling.updated(sampling.sample(a, 50), b, 50).collect()} == {r.sample_id for r in got}
    every = {r.sample_id: r.position for r in sampling.positions(df).collect()}
    assert sorted(every.values()) == list(range(len(x) + 3)) and {r.sample_id: r.position for r in got} == {i: p for i, p in every.items() if p < 50}
    assert sampling.positions(df.limit(0)).count() == 0
    ids = spark.range(40).withColumnRenamed("id", "sample_id")
    drawn = np.bincount([r.sample_id for s in range(60) for r in sampling.sample(ids, 10, seed=7 * s).collect()], minlength=40)
    assert drawn.sum() == 600 and ((drawn - 15) ** 2 / 15).sum() < 75  # 39 degrees of freedom, below 0.1 %


@pytest.mark.parametrize("leaf", [10_000, 100])
def test_clusters_equal_brute_force(data, leaf):
    x, d, df = data
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(d <= 1, label[None], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    size = np.bincount(label, minlength=len(x))
    got = clusters.clusters(df, 1.0, 3, leaf_rows=leaf).collect()
    assert {(r.sample_id, r.cluster_id, r["size"]) for r in got} == {(i, label[i], size[label[i]]) for i in range(len(x)) if size[label[i]] >= 3}
    assert len(got) == len({r.sample_id for r in got})
    assert clusters.clusters(df, 1.0, 1, leaf_rows=leaf).count() == len(x)


def test_described(data):
    x, _, df = data
    rows = clusters.described(df, 1.0, 3, 3).collect()
    assert all(len(r.typical) == 3 for r in rows) and sum(r["size"] for r in rows) == clusters.clusters(df, 1.0, 3).count()


@pytest.mark.parametrize("leaf", [10_000, 150])
def test_neighbours_against_brute_force(data, leaf):
    x, d, df = data
    kth = np.sort(d, axis=1)[:, 4]
    near = (d <= kth[:, None]) & (d <= 1)
    want = {(min(i, j), max(i, j)) for i, j in zip(*np.nonzero(near))}
    got = [(r.a, r.b) for r in neighbours.nearest_pairs(df, 5, 1.0, leaf_rows=leaf).collect()]
    assert len(got) == len(set(got)) and len(want & set(got)) >= 0.97 * len(want) and len(set(got) - want) <= 0.03 * len(want)
    found = {(r.q, r.n) for r in neighbours.nearest(df, 5, leaf_rows=leaf).collect()}
    true = set(zip(*np.nonzero(d <= kth[:, None])))
    assert len(true & found) >= 0.9 * len(true)


def test_varied(data):
    x, d, df = data
    got = diversity.varied(df, 40).collect()
    ids = [r.sample_id for r in got]
    assert len(set(ids)) == 40
    cover = lambda s: np.sqrt(np.where(np.isinf(d[:, s]), 0, d[:, s]).min(1)).mean()
    rng = np.random.default_rng(0)
    assert cover(ids) < np.mean([cover(rng.choice(len(x), 40, replace=False)) for _ in range(10)])
    assert diversity.varied(df.limit(0), 5).count() == 0
    assert diversity.varied(df.where("sample_id < 7"), 40).count() == 7


def test_varied_gives_as_many_as_asked_for(spark):
    x = np.random.default_rng(5).normal(0, 9, (5000, 12)).round(3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(7, *map(float, x[7]))] * 300, "sample_id long, " + ", ".join(f"{c} double" for c in DIMENSIONS))
    got = [r.sample_id for r in diversity.varied(df, 1500).collect()]
    assert len(got) == len(set(got)) == 1500


def test_ward_equals_its_definition():
    c = np.random.default_rng(3).normal(0, 1, (60, 3))
    group = [[i] for i in range(60)]
    while len(group) > 7:
        cost = [(len(a) * len(b) / (len(a) + len(b)) * np.square(c[a].mean(0) - c[b].mean(0)).sum(), i, j) for i, a in enumerate(group) for j, b in enumerate(group) if i < j]
        _, i, j = min(cost)
        group[i] += group.pop(j)
    got = diversity.ward(c, 7)
    assert sorted(map(sorted, group)) == sorted(sorted(np.flatnonzero(got == g)) for g in range(7))


def test_nearest_of_copies_and_few(spark):
    schema = "sample_id long, " + ", ".join(f"{c} double" for c in DIMENSIONS)
    rows = [(i, *[2.0] * 12) for i in range(9)] + [(20, *[3.0] * 12)]
    got = neighbours.nearest(spark.createDataFrame(rows, schema), 5).collect()
    of = lambda q: sorted((r.d2, r.n) for r in got if r.q == q)
    assert of(0) == [(0.0, i) for i in range(1, 6)] and of(8) == [(0.0, i) for i in range(5)]
    assert of(20) == [(12.0, i) for i in range(5)] and len(got) == 50
    two = neighbours.nearest(spark.createDataFrame(rows[8:], schema), 5).collect()
    assert sorted((r.q, r.n) for r in two) == [(8, 20), (20, 8)]
    assert neighbours.nearest(spark.createDataFrame([], schema), 5).count() == 0


def test_empty_tables_and_equal_vectors(spark):
    schema = "sample_id long, " + ", ".join(f"{c} double" for c in DIMENSIONS)
    none = spark.createDataFrame([], schema)
    assert clusters.clusters(none).count() == 0 and neighbours.nearest_pairs(none, 5, 1.0).count() == 0
    same = spark.createDataFrame([(i, *[2.0] * 12) for i in range(9)], schema)
    assert neighbours.nearest_pairs(same, 5, 1.0).count() == 36
    assert {r.cluster_id for r in clusters.clusters(same).collect()} == {0}
    assert len(fit_tree(np.ones((500, 12)), 8).box_low) == 1


def test_repeated_deliveries_do_not_shrink_the_reach(spark):
    rows = [(i, float(i)) for i in range(1000)] + [(500, 500.0)] * 20
    df = spark.createDataFrame(rows, "id long, a double")
    tree = shards.sampled_tree(df, 100, "id", ["a"])
    x = np.array([[500.0], [501.0]])
    # five other ids of each lie within 3
    assert tree.leaves > 1 and shards._reach(x, tree.home(x), tree, 5, np.inf).min() >= 3
