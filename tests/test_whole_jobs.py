"""Operators on frames where a bound or a subset would cut the job short."""

from netloom.operators import models as M
from netloom.plans import frames
from pyspark.sql import functions as F


def test_rates_over_the_terms_of_a_draw(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") < 10).cast("int"))
    n = {r.y: r["count"] for r in M.resampled(M.stratified_weights(df, "y"), "weight", 10_000, "id").groupBy("y").count().collect()}
    assert abs(n[1] - 5000) < 350 and abs(n[0] - 5000) < 350  # ten rows of rate 500: five standard deviations


def test_rules_are_the_whole_table(spark, sf):
    assert "WHERE" not in frames.RULES
    rules = frames.frame(spark, "/root/testdata/sf0.01", "rules")
    assert rules.count() == spark.read.parquet("/root/testdata/sf0.01/customer.parquet").count() == 1500
