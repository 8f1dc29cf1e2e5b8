import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import density, topics


def table(spark, x):
    return spark.createDataFrame([(f"{k:05d}", v.tolist()) for k, v in enumerate(x)], "id string, embedding array<float>")


def alike(a, b):
    """Whether two labellings are the same partition with the same noise."""
    return len(set(zip(a, b))) == len(set(a)) == len(set(b)) and all((p == -1) == (q == -1) for p, q in zip(a, b))


def planted(rng, sizes, dim, noise):
    centres = rng.normal(0, 1, (len(sizes), dim))
    x = np.concatenate([c + rng.normal(0, 0.12, (n, dim)) for c, n in zip(centres, sizes)] + [rng.normal(0, 1, (noise, dim))])
    return rng.permutation(x).astype(np.float32)


@pytest.fixture(params=[(4096, 1 << 18), (40, 37), (16, 1 << 18)])
def parts(request, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", request.param[0])
    monkeypatch.setattr(density, "RUN", request.param[1])


def test_equals_the_kernel(spark, parts):
    x = planted(np.random.default_rng(1), (40, 25, 12), 8, 20)
    got = density.clusters(table(spark, x), 5).orderBy("id").collect()
    want = topics.density_clusters(topics.reduce(x.astype(float)), 5)
    assert [r.id for r in got] == [f"{k:05d}" for k in range(len(x))] and alike([r.label for r in got], want.tolist())
    unit = topics.reduce(x.astype(float))
    for r in got:
        if r.label >= 0:
            mean = unit[[s.label == r.label for s in got]].mean(axis=0)
            assert abs(r.to_centre - np.linalg.norm(unit[int(r.id)] - mean / np.linalg.norm(mean))) < 1e-6


def test_blocks_give_the_same_tree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (150, 4))
    x[100:120] = x[3]  # ties
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "g long, x array<double>")
    trees = []
    for block in (4096, 33):
        monkeypatch.setattr(density, "BLOCK", block)
        core = {r.g: r.core for r in density.core_distances(points, 150, 5).collect()}
        want = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[:, 4]
        assert np.allclose([core[k] for k in range(150)], want, atol=1e-7)
        exact = spark.createDataFrame([(k, v.tolist(), float(want[k])) for k, v in enumerate(x)], "g long, x array<double>, core double")
        trees.append(sorted(map(tuple, density.tree_edges(exact, 150).collect())))
    assert len(trees[0]) == 149 and np.allclose([t[2] for t in sorted(trees[0], key=lambda t: t[2])], [t[2] for t in sorted(trees[1], key=lambda t: t[2])])
    seen = {0}
    for _ in range(150):
        seen |= {b for u, v, _ in trees[1] for a, b in ((u, v), (v, u)) if a in seen}
    assert len(seen) == 150


def test_principal_axes_keep_distances(spark):
    x = np.random.default_rng(3).normal(0, 1, (90, 60)).astype(np.float32)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "g long, embedding array<float>").repartition(4)
    got = np.array([r.x for r in density.reduced(points, 10).orderBy("g").collect()])
    want = topics.reduce(x.astype(float), 10)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-8)


def test_few_and_odd_rows(spark):
    assert density.clusters(table(spark, np.zeros((0, 3)))).collect() == []
    assert [r.label for r in density.clusters(table(spark, np.eye(3, dtype=np.float32))).collect()] == [-1] * 3
    same = np.concatenate([np.tile([1.0, 0, 0], (8, 1)), np.tile([0, 1.0, 0], (8, 1))]).astype(np.float32)
    rows = table(spark, same).union(spark.createDataFrame([("none", None)], "id string, embedding array<float>"))
    got = {r.id: r.label for r in density.clusters(rows).collect()}
    assert got["none"] == -1 and len({got[f"{k:05d}"] for k in range(8)}) == 1 and got["00000"] != got["00008"] and min(got["00000"], got["00008"]) >= 0


def test_tree_between_two_sides_equals_all_edges():
    rng = np.random.default_rng(6)
    for n, left in ((80, 0), (80, 30), (7, 1), (2, 1)):
        x, core = np.round(rng.standard_normal((n, 3))), np.round(rng.random(n))  # many ties
        d = np.maximum(np.maximum(density._distances(x, x), core[:, None]), core)
        a, b = np.triu_indices(n, 1)
        a, b = (a[(a < left) & (b >= left)], b[(a < left) & (b >= left)]) if left else (a, b)
        inside = density.lightest(a, b, d[a, b])
        u, v, w, _ = density.spanning_tree(x, core, left)
        assert sorted(zip(u, v)) == sorted(zip(a[inside], b[inside])) and np.allclose(w, d[u, v])


def test_pairs_of_blocks_make_few_edges(spark, monkeypatch):
    """A pair adds edges between its blocks only, and none that the blocks' own trees make needless."""
    monkeypatch.setattr(density, "BLOCK", 32)
    given, whole = [], density.boruvka
    monkeypatch.setattr(density, "boruvka", lambda edges: given.append(edges) or whole(edges))
    x = np.random.default_rng(8).standard_normal((128, 4))
    points = spark.createDataFrame([(k, v.tolist(), 0.0) for k, v in enumerate(x)], "g long, x array<double>, core double")
    assert density.tree_edges(points, 128).count() == 127
    made = [(r.u, r.v) for r in given[0].collect()]
    assert len(made) == len(set(made)) and len(made) < 4 * 31 + 6 * 63


def test_nearest_do_not_keep_their_slab():
    source = density.least_of(np.random.default_rng(1).random((10, 50)), 3)
    assert source.shape == (10, 3) and source.base is None


def all_pairs(x, core):
    """The tree of all pairs by (w, u, v)."""
    a, b = np.triu_indices(len(x), 1)
    w = np.maximum(np.maximum(np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1)), core[a]), core[b])
    inside = density.lightest(a, b, w)
    return sorted(zip(a[inside].tolist(), b[inside].tolist(), w[inside].tolist()))


def cores(x, least):
    return np.array([np.partition(np.sqrt(((x - p) ** 2).sum(axis=1)), least - 1)[least - 1] for p in x])


@pytest.mark.parametrize("block, near, sample", [(1 << 15, 8, 4096), (64, 8, 20), (50, 4, 5)])
def test_tree_is_that_of_all_pairs(spark, monkeypatch, block, near, sample):
    """Edge by edge, also where core distances make many equal weights, where near points leave parts unconnected and where a sample joins them badly."""
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "NEAR", near, raising=False)
    monkeypatch.setattr(density, "SAMPLE", sample, raising=False)
    x = planted(np.random.default_rng(11), (60, 40, 30, 12), 6, 60).astype(float)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "g long, x array<double>")
    held = points.join(density.core_distances(points, len(x), 5), "g").localCheckpoint()
    assert np.array_equal([r.core for r in held.orderBy("g").collect()], cores(x, 5))
    assert sorted(map(tuple, density.tree_edges(held, len(x)).collect())) == all_pairs(x, cores(x, 5))


def test_equal_rows_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.standard_normal((50, 5)), np.tile(rng.standard_normal(5), (90, 1)), np.repeat(rng.standard_normal((9, 5)), 3, axis=0), np.repeat(rng.standard_normal((4, 5)), 5, axis=0)])
    x = np.round(rng.permutation(x), 3).astype(np.float32)
    compared, whole = [], density.near
    monkeypatch.setattr(density, "near", lambda points, n, k: compared.append(n) or whole(points, n, k))
    for rows in (x, np.tile(x[:1], (12, 1))):
        held = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "g long, embedding array<float>").localCheckpoint()
        points = density.reduced(held).localCheckpoint()
        unit = np.array([r.x for r in points.orderBy("g").collect()])
        assert sorted(map(tuple, density._whole_tree(held, points, len(rows), 5).collect())) == all_pairs(unit, cores(unit, 5))
    assert compared == [50 + 1 + 27 + 4]


def test_near_points_leave_few_edges_to_find(spark, monkeypatch):
    """What pairs of blocks add to the tree's edges does not grow with the number of pairs."""
    monkeypatch.setattr(density, "BLOCK", 64)
    given, whole = [], density.boruvka
    monkeypatch.setattr(density, "boruvka", lambda edges: given.append(edges) or whole(edges))
    x = np.random.default_rng(13).standard_normal((700, 12))
    points = spark.createDataFrame([(k, v.tolist(), c) for k, (v, c) in enumerate(zip(x, cores(x, 5).tolist()))], "g long, x array<double>, core double")
    assert density.tree_edges(points, 700).count() == 699 and given[0].count() < 750
