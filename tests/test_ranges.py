"""What a task holds, and how often values are made, as tables grow."""

import numpy as np
from pyspark.sql import functions as F

from netloom.operators import forest as T
from netloom.operators import metrics as M
from netloom.operators import running as R


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 500, raising=False)
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"), F.lit(1).alias("n"))
    out = R.running(df, ["k"], "x", ["n"]).withColumn("_p", F.spark_partition_id())
    assert out.where("upto_n <> x + 1 OR all_n <> 20000").count() == 0
    assert out.groupBy("_p").count().agg(F.max("count")).first()[0] < 4000
    placed = R.positions(df, [F.col("x")]).withColumn("_p", F.spark_partition_id())
    assert placed.where("place <> x").count() == 0 and placed.groupBy("_p").count().agg(F.max("count")).first()[0] < 4000


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 3.0, 5), ("a", 2.0, 1)], "k string, x double, n int")
    assert {(r.k, r.x): (r.upto_n, r.all_n) for r in R.running(df, ["k"], "x", ["n"]).collect()} == {(None, 1.0): (2, 7), (None, 3.0): (7, 7), ("a", 2.0): (1, 1)}


def test_compared_values_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        made.add(1)
        return x

    df = spark.range(1000).select(F.lit("m").alias("method"), value((F.col("id") % 7).cast("double")).alias("v"), (F.col("id") % 3 == 0).alias("attack"))
    row = M.compared_methods(df, 0.05).collect()[0]
    assert made.value == 1000 and row.method == "m" and row.alert_rate == 0.0


def test_walks_without_a_question_at_leaves(spark):
    df = spark.range(300).select(F.col("id").alias("key"), (F.col("id") % 17).cast("double").alias("a"), F.when(F.col("id") == 5, 90.0).otherwise(1.0).alias("b"))
    forest = T.fit(df, "key", ["a", "b"], trees=9, per_tree=40)
    x = np.array([[r.a, r.b] for r in df.collect()])
    want = np.zeros(len(x))
    for feature, cut, path in zip(forest.feature, forest.cut, forest.path):
        for i, row in enumerate(x):
            node = 1
            while feature[node] >= 0:
                node = 2 * node + int(row[feature[node]] > cut[node])
            want[i] += path[node]
    assert np.array_equal(forest.scores(x), 2.0 ** (-(want / 9) / float(T.mean_depth(forest.per_tree))))
