"""Gradients against finite differences, rounds against the sum over chunks, and training that lowers the loss."""

import numpy as np
import pytest

from netloom.operators import training as N

SHAPE = N.Shape(4, 3, hidden=6, blocks=2, ae_hidden=4, projection=(5, 3), weights=(1.0, 5.0, 2.0), pair=(1, 2), chunk=64)


def batch(n, seed=1):
    r = np.random.default_rng(seed)
    y = r.integers(0, 3, n)
    return r.normal(size=(n, 4)) + y[:, None], y


def test_slopes_equal_finite_differences():
    x, y = batch(24)
    flat = N.start(SHAPE, 3) + 0.05 * np.random.default_rng(2).normal(size=len(N.start(SHAPE)))
    work = N.Pass(SHAPE, flat)
    work.loss(x, y)
    value = lambda w: N.Pass(SHAPE, w).loss(x, y, slopes=False)["total"]
    at = 0
    for name, size in SHAPE.layers().items():
        n = int(np.prod(size))
        for i in {at, at + n // 2, at + n - 1}:
            step = np.zeros_like(flat)
            step[i] = 1e-5
            assert work.grad[i] == pytest.approx((value(flat + step) - value(flat - step)) / 2e-5, rel=2e-3, abs=2e-6), name
        at += n
    assert at == len(flat)


def test_losses_of_small_cases():
    logits = np.log(np.array([[0.7, 0.2, 0.1], [0.1, 0.6, 0.3]]))
    y = np.array([0, 2])
    plain = N.Shape(4, 3, gamma=2.0)
    want = []
    for row, label in ((np.array([0.7, 0.2, 0.1]), 0), (np.array([0.1, 0.6, 0.3]), 2)):
        ce = -0.95 * np.log(row[label]) - 0.05 / 3 * np.log(row).sum()
        want.append((1 - row[label]) ** 2 * ce)
    assert N.focal_loss(logits, y, plain)[0] == pytest.approx(np.mean(want))
    paired = N.Shape(4, 3, gamma=2.0, pair=(1, 2))
    assert N.focal_loss(logits, y, paired)[0] == pytest.approx((want[0] + 2 * want[1]) / 2)
    e = np.array([[1.0, 0], [0, 1.0], [0.6, 0.8]])
    assert N.contrastive_loss(e, np.array([0, 1, 2]), None)[0] == 0  # no positives
    cos = e @ e.T / 0.15
    one = lambda i, j: np.log(sum(np.exp(cos[i, k]) for k in range(3) if k != i)) - cos[i, j]
    assert N.contrastive_loss(e, np.array([0, 1, 0]), None)[0] == pytest.approx((one(0, 2) + one(2, 0)) / 2)


def frame(spark, n, seed=1):
    x, y = batch(n, seed)
    rows = [(i, *map(float, v), "abc"[c]) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, f3 double, label string")


def test_a_round_is_the_mean_over_all_rows(spark):
    df = frame(spark, 300).coalesce(1)
    rows = N.rows_of(df, "id", ["f0", "f1", "f2", "f3"], "label", list("abc"))
    flat = N.start(SHAPE)
    n, losses, grad = N.round_sums(rows, SHAPE, flat)
    local = rows.collect()
    x, y = np.array([r.x for r in local]), np.array([r.y for r in local])
    want, total = np.zeros_like(flat), 0.0
    for at in range(0, 300, 64):
        work = N.Pass(SHAPE, flat)
        total += len(y[at : at + 64]) * work.loss(x[at : at + 64], y[at : at + 64])["total"]
        want += len(y[at : at + 64]) * work.grad
    assert n == 300 and losses["total"] == pytest.approx(total / 300) and np.allclose(grad, want / 300)


def test_training_lowers_the_loss_and_scores(spark):
    rows = N.rows_of(frame(spark, 900).repartition(3), "id", ["f0", "f1", "f2", "f3"], "label", list("abc"))
    held = N.rows_of(frame(spark, 200, 9), "id", ["f0", "f1", "f2", "f3"], "label", list("abc"))
    flat, history = N.train(rows, held, SHAPE, rounds=12, rate=2e-2)
    assert history[-1]["total"] < 0.8 * history[0]["total"] and min(h["held"] for h in history) < history[0]["held"]
    out = N.scored(rows, SHAPE, flat, list("abc")).join(rows.select("key", "y"), "key").collect()
    assert len(out) == 900 and np.mean(["abc"[r.y] == r.classifier_class for r in out]) > 0.5
    x = np.random.default_rng(4).normal(size=(3, 4))
    found = N.outputs(SHAPE, flat, x)
    work = N.Pass(SHAPE, flat)
    h, _ = work.backbone(x)
    for i in range(3):  # the slope score by finite differences of the cross entropy at the last layer
        loss = lambda v, i=i: -N.log_softmax((v @ work.w["head.w"] + work.w["head.b"])[None])[0, found["guess"][i]]
        slope = [(loss(h[i] + d) - loss(h[i] - d)) / 2e-6 for d in 1e-6 * np.eye(6)]
        assert found["slope"][i] == pytest.approx(np.linalg.norm(slope), rel=1e-4)


def test_training_edges(spark):
    df = frame(spark, 20)
    with pytest.raises(Exception, match="not a class"):
        N.rows_of(df, "id", ["f0"], "label", ["a"]).collect()
    empty = N.rows_of(df.limit(0), "id", ["f0", "f1", "f2", "f3"], "label", list("abc"))
    with pytest.raises(ValueError):
        N.round_sums(empty, SHAPE, N.start(SHAPE))
    odd = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0, "a"), (2, float("nan"), 1.0, 1.0, 1.0, "a"), (3, 1.0, 1.0, 1.0, 1.0, None), (4, 1.0, 1.0, 1.0, 1.0, "b")], df.schema)
    assert [r.key for r in N.rows_of(odd, "id", ["f0", "f1", "f2", "f3"], "label", list("abc")).collect()] == ["4"]


def test_contrast_makes_few_numbers_a_pair():
    """A chunk's cost is what it makes for each pair of its rows: two arrays of similarities, and the plain formula's value."""
    import tracemalloc

    r = np.random.default_rng(4)
    e, y, n = r.normal(size=(600, 8)), r.integers(0, 3, 600), 600
    e /= np.sqrt((e * e).sum(axis=1, keepdims=True))
    tracemalloc.start()
    value, _ = N.contrastive_loss(e, y, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sim = e @ e.T / N.TEMPERATURE
    np.fill_diagonal(sim, -np.inf)
    mates = (y[:, None] == y[None, :]) & ~np.eye(n, dtype=bool)
    logs = np.where(mates, sim - np.log(np.exp(sim).sum(axis=1, keepdims=True)), 0.0)
    assert abs(value + (logs.sum(axis=1) / mates.sum(axis=1)).mean()) < 1e-9
    assert peak < 3 * 8 * n * n
