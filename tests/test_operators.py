"""Operators on small frames: cumulative sums, joins, purges, splits, alerts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators import alerts as A
from netloom.operators import folds as D
from netloom.operators import identity as I
from netloom.operators import labels as L
from netloom.operators import metrics as M
from netloom.operators import production as P
from netloom.operators.running import quantiles, running


def test_running_equals_one_pass(spark):
    r = np.random.default_rng(2)
    rows = [(int(k), float(x), int(n)) for k, x, n in zip(r.integers(0, 3, 500), r.permutation(500) / 7, r.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "k int, x double, n long").repartition(3)
    got = {(q.k, q.x): (q.upto_n, q.all_n) for q in running(df, ["k"], "x", ["n"], buckets=7).collect()}
    for k, x, _ in rows:
        mine = [n for kk, xx, n in rows if kk == k and xx <= x]
        assert got[k, x] == (sum(mine), sum(n for kk, _, n in rows if kk == k))


def test_quantiles_equal_numpy(spark):
    x = np.random.default_rng(3).integers(0, 40, 333) / 3
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    row = quantiles(df, [], "x", {"a": 0.0, "b": 0.37, "c": 1.0}).first()
    assert row.n == 333 and np.allclose([row.a, row.b, row.c], np.quantile(x, [0, 0.37, 1]))
    higher = M.upper_quantile(df.where("x IS NOT NULL"), "x", 0.9).first().threshold
    assert np.isclose(higher, np.quantile(x, 0.9, method="higher"))


def test_auroc_and_ap_equal_definitions(spark):
    r = np.random.default_rng(4)
    y, s = r.integers(0, 2, 200), r.integers(0, 30, 200) / 10
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    row = M.ranking(df, "s", F.col("y") == 1).first()
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert np.isclose(row.auroc, pairs)
    ap, seen = 0.0, 0
    for v in sorted(set(s), reverse=True):
        k, p = (s >= v).sum(), (y[s >= v]).sum()
        ap += (p - seen) / y.sum() * p / k
        seen = p
    assert np.isclose(row.average_precision, ap)


def test_anchored_clusters(spark):
    minute = 60_000_000
    rows = [("k", f"a{i}", t * minute) for i, t in enumerate((0, 8, 15, 16, 40, 41, 56))]
    out = A.anchored(spark.createDataFrame(rows, "key string, alert_id string, t long"), ["key"], "t", "alert_id", 15 * minute)
    assert [r.cluster_start // minute for r in out.orderBy("t").collect()] == [0, 0, 0, 16, 40, 40, 56]


def test_decisions_and_rules(spark):
    df = spark.createDataFrame([(0.9, 0.5, 0.9), (0.9, 0.9, 0.1), (0.6, 0.5, 0.2)], "ae double, p double, h double")
    for thresholds, want, rule in (
        ({"decision_mode": "vote", "min_votes": 2, "hybrid": 0.5, "ae_re": 0.8, "softmax": 0.4}, [True, False, False], "vote_2_of_3"),
        ({"hybrid": 0.15}, [True, False, True], "hybrid_calibrated"),
        (None, [True, False, True], "ae_plus_confidence_fallback"),
    ):
        flag, name = S.anomaly_decision(F.col("ae"), F.col("p"), F.col("h"), thresholds)
        assert ([r[0] for r in df.select(flag).collect()], name) == (want, rule)


def test_risk_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(0.1, 0.0, False, "LOW"), (0.3, 0.0, False, "x"), (2.0, 9.0, True, "CRITICAL")], "h double, a double, z boolean, s string")
    got = [r[0] for r in df.select(S.risk_score(F.col("h"), F.col("a"), F.col("z"), F.col("s"))).collect()]
    assert got == [round(5 + 4.5), round(10 + 13.5), 100]


def test_category_tokens_and_bits(spark):
    df = spark.createDataFrame([("Straße ", 1.5), ("ﬁ", -0.0), (None, None)], "c string, x double")
    got = df.select(S.full_category_token("c").alias("t"), S.big_endian_hex("x").alias("b")).collect()
    assert [r.t for r in got] == ["value:strasse", "value:fi", "missing:"]
    assert [r.b for r in got] == ["3ff8000000000000", "0" * 16, None]


def test_fold_has_no_leak_and_a_planted_one_is_found(spark):
    rows = [(f"i{i % 40}", ["Normal", "DoS", "Worms", "Fuzzers"][i % 4]) for i in range(160)] + [("i0", "Worms"), ("i3", "DoS")]
    fold = D.isolated_fold(spark.createDataFrame(rows, "identity string, label string"), "Worms")
    assert D.leaks(fold).count() == 0
    planted = fold.unionByName(fold.where("role = 'target'").limit(1).withColumn("role", F.lit("train")))
    assert D.leaks(planted).count() >= 1


def test_priority_and_fingerprints(spark):
    df = spark.createDataFrame([("a", "val"), ("a", "train"), ("b", "calibration")], "identity string, role string")
    assert sorted(map(tuple, I.by_priority(df).collect())) == [("a", "train"), ("b", "calibration")]
    x = spark.createDataFrame([(0.0, None), (-0.0, None), (1e-9, ""), (0.0, "missing:"), (1e-9 + 1e-20, ""), (0.0, "Tcp"), (0.0, " TCP "), (0.0, "\uff34cp")], "x double, s string")
    ids = [r.identity for r in I.with_identity(x, ["x"], ["s"]).collect()]
    assert ids[0] == ids[1] and ids[2] == ids[4] and len(set(ids)) == 6
    ids = [r.identity for r in I.with_canonical_identity(x, ["x"], ["s"]).collect()]
    assert ids[5] == ids[6] == ids[7] and len(set(ids)) == 4
    bad = spark.createDataFrame([(float("inf"),)], "x double")
    with pytest.raises(Exception, match="not finite"):
        I.with_input_identity(bad, ["x"]).collect()
    with pytest.raises(ValueError, match="features"):
        I.with_identity(bad.withColumn("label", F.lit(1)), ["label"], [])


def test_gates_raise(spark):
    good = spark.createDataFrame([("a", "train", "DoS"), ("b", "target", "Worms")], "identity string, role string, label string")
    assert D.require_isolated(good).count() == 2
    for extra in (("a", "val", "DoS"), ("c", "train", "Worms")):
        with pytest.raises(ValueError, match="leaks"):
            D.require_isolated(good.union(spark.createDataFrame([extra], good.schema)))
    families = good.select(F.col("label").alias("attack_cat"))
    assert L.require_declared(families).count() == 2
    with pytest.raises(ValueError, match="Novel"):
        L.require_declared(families.union(spark.createDataFrame([("Novel",)], families.schema)))


def test_first_time_that_can_be_read(spark):
    raw = spark.createDataFrame([(1, "no time", "2024-01-02 03:04:05"), (2, "", "2024-01-02 03:04:06")], "n long, timestamp string, stime string")
    got = sorted((r.source_row, r.event_time) for r in P.to_contract(raw, "n")[0].collect())
    assert [t for _, t in got] == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:06Z"]


def test_tolerances(spark):
    assert (S.tolerance("seconds"), S.tolerance("bytes"), S.tolerance("bits/second"), S.tolerance("else")) == ((1e-9, 1e-12), (0.0, 0.0), (1e-9, 1e-9), (0.0, 0.0))
    x = spark.createDataFrame([(1.0, 1.0 + 5e-10), (1.0, 1.0 + 5e-9), (None, None), (1.0, None)], "a double, b double")
    assert [r[0] for r in x.select(S.within_tolerance(F.col("a"), F.col("b"), "seconds")).collect()] == [True, False, True, False]


def test_clusters_follow_their_anchor(spark):
    rng = random.Random(4)
    rows = [("k" if i % 3 else "hot", rng.randrange(0, 200_000), i) for i in range(3000)] + [("one", -5, 0), ("hot", 10**7, 1)]
    df = spark.createDataFrame(rows, "key string, t long, id long")
    got = {(r.key, r.t, r.id): r.cluster_start for r in A.anchored(df, ["key"], "t", "id", 37).collect()}
    for key in ("k", "hot", "one"):
        anchor = None
        for _, t, i in sorted(r for r in rows if r[0] == key):
            anchor = t if anchor is None or t - anchor > 37 else anchor
            assert got[key, t, i] == anchor


def test_status_changes(spark):
    store = spark.createDataFrame([("a", "new", None, 1)], "alert_id string, status string, analyst_note string, updated_at long")
    changes = spark.createDataFrame([("a", "open", "x", 2), ("a", "closed", "y", 3), ("z", "open", "", 2)], "alert_id string, status string, note string, at long")
    out, missing = A.status_changed(store, changes)
    assert tuple(out.first()) == ("a", "closed", "y", 3) and [r.alert_id for r in missing.collect()] == ["z"]
