"""The ordered hash and the stratified bootstrap."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import metrics as M
from netloom.sources import sinks


@pytest.mark.parametrize("size", [4096, 7])
def test_ordered_hash(spark, monkeypatch, size):
    monkeypatch.setattr(sinks, "RANGE", size)
    rows = [(i, f"v{i % 50}", float(i % 3)) for i in range(400)] + [(7, "v7", 1.0)] * 3
    df = spark.createDataFrame(rows, "i long, v string, x double")
    want = sinks.ordered_hash(df, ["i"])
    assert sinks.ordered_hash(df.repartition(13, "v"), ["i"]) == sinks.ordered_hash(df.coalesce(1).orderBy(F.desc("i")), ["i"]) == want
    swapped = [(i, "v2" if i == 1 else "v1" if i == 2 else v, x) for i, v, x in rows]
    assert sinks.ordered_hash(spark.createDataFrame(swapped, df.schema), ["i"]) != want
    assert sinks.ordered_hash(df.withColumn("i", -F.col("i")).withColumn("i", -F.col("i")), ["v", "i"]) != want
    assert sinks.ordered_hash(spark.createDataFrame(rows[:-1], df.schema), ["i"]) != want
    assert sinks.ordered_hash(df.limit(0), ["i"]) == hashlib.sha256(b"").hexdigest()
    zero = lambda v: spark.createDataFrame([(1, v)], "i long, x double")
    assert sinks.ordered_hash(zero(0.0), ["i"]) == sinks.ordered_hash(zero(-0.0), ["i"]) != sinks.ordered_hash(zero(None), ["i"])


def test_bootstrap_equals_replicates_played_one_by_one(spark):
    r = np.random.default_rng(3)
    positive, negative = r.normal(0.6, 0.2, 40).round(2), r.normal(0.4, 0.2, 70).round(2)
    df = spark.createDataFrame([(float(v), True) for v in positive] + [(float(v), False) for v in negative] + [(None, True)], "s double, pos boolean")
    got = {x.name: x for x in M.bootstrap(df, "s", F.col("pos"), replicates=60, threshold=0.5).collect()}
    values = {k: [] for k in ("auroc", "average_precision", "tpr", "fpr")}
    for rep in range(1, 61):
        drawn = []
        for name, members in (("p", np.sort(positive)), ("n", np.sort(negative))):
            n = len(members)
            u = [int(hashlib.md5(f"7|{name}|{rep}|{j}".encode()).hexdigest()[:13], 16) / 2**52 for j in range(n)]
            drawn.append(members[[int(x * n) for x in u]])
        p, n = drawn
        assert (len(p), len(n)) == (40, 70)
        values["auroc"].append(np.mean([(a > n).mean() + (a == n).mean() / 2 for a in p]))
        values["average_precision"].append(np.mean([(p >= a).sum() / ((p >= a).sum() + (n >= a).sum()) for a in p]))
        values["tpr"].append((p > 0.5).mean()), values["fpr"].append((n > 0.5).mean())
    for k, v in values.items():
        assert (got[k].lo, got[k].hi) == pytest.approx(tuple(np.quantile(v, [0.025, 0.975])))
        assert (got[k].valid, got[k].discarded) == (60, 0)


def test_bootstrap_limits(spark, monkeypatch):
    df = spark.createDataFrame([(0.1, True), (0.2, False), (0.3, False)], "s double, pos boolean")
    with pytest.raises(ValueError):
        M.bootstrap(df.where("pos"), "s", F.col("pos"))
    with pytest.raises(ValueError):
        M.bootstrap(df, "s", F.col("pos"), replicates=5, least_valid=6)
    monkeypatch.setattr(M, "MOST_SCORES", 2)
    with pytest.raises(ValueError, match="distinct"):
        M.bootstrap(df, "s", F.col("pos"))


def test_compared_methods(spark):
    rows = [("a", i / 100, i >= 80) for i in range(100)] + [("b", (i * 37 % 100) / 100, i >= 80) for i in range(100)]
    got = {r.method: r for r in M.compared_methods(spark.createDataFrame(rows, "method string, v double, attack boolean"), 0.05).collect()}
    assert got["a"].auroc == 1 and got["a"].attack_detection_rate == 1 and got["a"].normal_fpr == pytest.approx(0.05) and 0.2 < got["b"].auroc < 0.8
