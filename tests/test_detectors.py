"""Detectors against brute force: trees walked row by row, neighbours over all pairs, centres by plain means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import clusters as C
from netloom.operators import forest as T
from netloom.operators import neighbours as N


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(11)
    x = np.concatenate([r.normal(0, 1, (400, 3)).round(1), np.tile([[0.5, 0.5, 0.5]], (150, 1)), [[9, 9, 9], [-8, 7, 0]]])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    rows[3] = (3, None, float("nan"), float("inf"))
    x[3] = 0
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5), x


def test_forest_equals_walks_row_by_row(spark, points):
    df, x = points
    forest = T.fit(df, "id", ["a", "b", "c"], trees=20, per_tree=64, most=300)
    got = {r.id: r.isolation for r in T.score(df, "id", ["a", "b", "c"], forest).collect()}
    assert len(got) == len(x)
    for i in (0, 3, 100, 450, len(x) - 2, len(x) - 1):
        paths = []
        for feature, cut, path in zip(forest.feature, forest.cut, forest.path):
            node = 1
            while feature[node] >= 0:
                node = 2 * node + int(x[i][feature[node]] > cut[node])
            paths.append(path[node])
        assert got[i] == pytest.approx(2 ** (-np.mean(paths) / T.mean_depth(64)))
    # the two rows far from all others are among the easiest to part
    assert {len(x) - 2, len(x) - 1} <= set(sorted(got, key=got.get)[-10:])
    again = T.fit(df.repartition(1), "id", ["a", "b", "c"], trees=20, per_tree=64, most=300)
    assert (again.feature == forest.feature).all() and (again.cut == forest.cut).all()


def test_forest_leaves_hold_their_rows(points):
    _, x = points
    nodes = T.grow(x[:64], 1, 0, 6)
    leaves = [n for n in nodes if n[1] < 0]
    assert sum(n[3] for n in leaves) == 64 and all(n[0] < 128 for n in nodes)
    assert T.mean_depth(np.array([0, 1, 2])).tolist() == [0, 0, 1] and T.mean_depth(256) == pytest.approx(10.2448, abs=1e-3)


def test_forest_edges(spark, points):
    df, _ = points
    with pytest.raises(ValueError):
        T.fit(df.limit(0), "id", ["a"])
    same = spark.createDataFrame([(i, 1.0) for i in range(10)], "id long, a double")
    forest = T.fit(same, "id", ["a"], trees=3)
    assert {round(r.isolation, 6) for r in T.score(same, "id", ["a"], forest).collect()} == {0.5}
    assert T.score(same.limit(0), "id", ["a"], forest).count() == 0


def brute_neighbours(x, ids, y, others, k, own):
    out = {}
    for i, v in zip(ids, x):
        d = np.sqrt(((v - y) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((others, d)) if not (own and others[j] == i)][:k]
        out[i] = [d[j] for j in order]
    return out


@pytest.mark.parametrize("ring", [1024, 16])
def test_neighbours_equal_brute_force(spark, points, monkeypatch, ring):
    df, x = points
    monkeypatch.setattr(N, "RING", ring)
    monkeypatch.setattr(N, "VISITS", 40)
    ids = np.arange(len(x))
    held = N.classes(df, "id", ["a", "b", "c"])
    assert held.agg(F.sum("n")).first()[0] == len(x) and held.count() < len(x) - 140
    for k, own in ((7, False), (7, True), (200, False), (10_000, False)):
        want = brute_neighbours(x, ids, x, ids, k, own)
        got = {}
        for r in N.nearest(held, held, k, 3, own).collect():
            got.setdefault(r.id, []).extend([r.d] * r.w)
        assert len(got) == held.count()
        for i, d in got.items():
            assert np.allclose(sorted(d), want[i]), (k, own, i)


def test_outlier_factor_equals_brute_force(spark, points):
    df, x = points
    fit = x[:300]
    got = {r.id: r.factor for r in N.outlier_factor(df, df.where("id < 300"), "id", ["a", "b", "c"], k=10).collect()}
    d = np.sqrt(((x[:, None] - fit[None]) ** 2).sum(axis=2))
    near_fit = [[j for j in np.argsort(d[i], kind="stable") if j != i][:10] for i in range(300)]
    kth = np.array([d[i, n[-1]] for i, n in enumerate(near_fit)])
    lrd = np.array([1 / (np.maximum(d[i, n], kth[n]).mean() + 1e-10) for i, n in enumerate(near_fit)])
    unclear = 0
    for i in range(len(x)):
        order = np.argsort(d[i], kind="stable")
        if d[i, order[9]] == d[i, order[10]]:  # which of equal neighbours counts is a matter of ties
            unclear += 1
            continue
        n = order[:10]
        assert got[i] == pytest.approx(lrd[n].mean() * (np.maximum(d[i, n], kth[n]).mean() + 1e-10), rel=1e-6), i
    assert len(got) == len(x) and unclear < len(x) / 2
    assert got[len(x) - 2] > 3 and got[len(x) - 1] > 3
    with pytest.raises(ValueError):
        N.outlier_factor(df, df.where("id < 2"), "id", ["a"])


def test_class_centres(spark):
    r = np.random.default_rng(5)
    middles = {"a": r.normal(0, 20, (6, 4)), "b": r.normal(0, 20, (2, 4))}
    rows = [(f"{name}{i}", name, (m[i % len(m)] + r.normal(0, 0.1, 4)).tolist()) for name, m in middles.items() for i in range(1500 if name == "a" else 60)]
    rows += [("c0", "c", [1.0, 2.0, 3.0, 4.0]), ("c1", "c", [1.0, 2.0, 3.0, 4.0]), ("c2", "c", [5.0, 2.0, 3.0, 4.0]), ("x", None, [1.0] * 4), ("y", "a", None), ("z", "a", [1.0, None, 1.0, 1.0]), ("w", "a", [float("nan")] * 4)]
    df = C.usable(spark.createDataFrame(rows, "key string, label string, v array<double>").repartition(6), "label", "key", "v")
    found, costs = C.centres(df, k=6)
    assert {n: len(c) for n, c in found.items()} == {"a": 6, "b": 6, "c": 2} and all(b <= a for a, b in zip(costs, costs[1:]))
    for m in middles["a"]:
        assert np.sqrt(((found["a"] - m) ** 2).sum(axis=1)).min() < 0.1
    out = C.table(df, found).collect()
    assert sum(r.n for r in out if r.label == "a") == 1500 and sum(r.n for r in out if r.label == "c") == 3
    assert C.centres(df.limit(0))[0] == {} and C.table(df, {}).count() == 0
    ones = C.usable(spark.createDataFrame([("k", "a", [3.0, 4.0]), ("z", "a", [0.0, 0.0])], "key string, label string, v array<double>"), "label", "key", "v", unit=True)
    assert {tuple(r.x) for r in ones.collect()} == {(0.6, 0.8), (0.0, 0.0)}
