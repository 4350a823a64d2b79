import numpy as np

from netloom.functions import scalars as S
from netloom.operators import labels as L
from netloom.operators import models as M
from pyspark.sql import functions as F


def test_network_scores(spark):
    r = np.random.default_rng(0)
    net = M.Network([(r.standard_normal((3, 4)), np.zeros(4)), (r.standard_normal((4, 2)), np.zeros(2))], [(np.eye(3), np.zeros(3))])
    df = spark.createDataFrame([(i, float(i), 1.0, None) for i in range(700)], "id long, a double, b double, c double").repartition(2)
    out = M.score_batches(df, "id", ["a", "b", "c"], net, ["Normal", "DoS"]).collect()
    x = np.array([[r.id, 1.0, 0.0] for r in out], np.float32)
    label, prob, error = net.scores(x)
    assert [r.classifier_class for r in out] == [["Normal", "DoS"][i] for i in label]
    assert np.allclose([r.max_prob for r in out], prob) and not error.any()


def test_hybrid_learner_separates(spark):
    rows = [(i % 2, 0.2 + 0.5 * (i % 2) + 0.001 * (i % 7), 0.9 - 0.4 * (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, ae_score double, max_prob double")
    coef, intercept = M.hybrid_learner(df, "y")
    score = S.hybrid_score(F.col("ae_score"), F.col("max_prob"), coef, intercept)
    assert df.where((score > 0.5) != (F.col("y") == 1)).count() == 0


def test_techniques_and_resampling(spark):
    e = spark.createDataFrame([(1, "T1", 0.4), (1, "T1", 0.9), (1, "T2", 0.9), (1, "T3", 0.1)], "a long, technique string, confidence double")
    assert [(r.technique, r.rank) for r in M.ranked_techniques(e, ["a"], 2).orderBy("rank").collect()] == [("T1", 1), ("T2", 2)]
    df = spark.range(2000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    n = M.resampled(M.stratified_weights(df, "y"), "weight", 4000, "id").groupBy("y").count().collect()
    assert all(abs(r["count"] - 2000) < 200 for r in n)


def test_vectors_and_centroids(spark):
    df = spark.createDataFrame([(1, "a", [0.0, 1.0]), (2, "a", [0.0, 3.0]), (3, "b", [5.0, 0.0])], "id long, label string, v array<double>")
    c = L.centroids(df, "label", "v")
    assert {r.label: r.centroid for r in c.collect()} == {"a": [0.0, 2.0], "b": [5.0, 0.0]}
    near = {r.id: (r.label, r.distance) for r in L.nearest_centroid(df, c, "label", "id", "v").collect()}
    assert near == {1: ("a", 1.0), 2: ("a", 1.0), 3: ("b", 0.0)}
    z = F.array(F.lit(1.0), F.lit(2.0))
    row = spark.range(1).select(S.softmax(z)[1].alias("p"), S.energy(z).alias("e"), S.cosine(z, z).alias("c"), S.reconstruction_error(z, F.array(F.lit(0.0), F.lit(0.0))).alias("r")).first()
    assert np.allclose([row.p, row.e, row.c, row.r], [1 / (1 + np.exp(-1)), -np.log(np.exp(1) + np.exp(2)), 1.0, 2.5])


def test_families_and_variance(spark):
    df = spark.createDataFrame([(" exploit ", 1.0, 1.0), (None, 2.0, 1.0), ("odd THING", 3.0, 1.0)], "c string, x double, y double")
    out = L.with_family(df, "c")
    assert sorted(r.attack_cat for r in out.collect()) == ["Exploits", "Normal", "Odd thing"]
    assert [r.attack_cat for r in L.undeclared(out).collect()] == ["Odd thing"]
    assert L.varying(df, ["x", "y"]) == ["x"]
