"""Exact splits, places over ranges, and hot keys that no task gets whole."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import identity as I
from netloom.operators import production as P
from netloom.operators.running import positions


def test_positions(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 END AS k").repartition(5)
    got = positions(df, [F.col("k").asc_nulls_last(), F.col("id").desc()]).orderBy("place").collect()
    want = sorted(((r.k is None, r.k or 0, -r.id) for r in df.collect()))
    assert [r.place for r in got] == list(range(1000)) and [-w[2] for w in want] == [r.id for r in got]
    assert positions(df.limit(0), [F.col("id")]).count() == 0


def test_a_hot_day_is_spread(spark):
    df = spark.range(4000).selectExpr("id AS row_id", "CASE WHEN id % 4 = 0 THEN NULL ELSE timestamp'2024-01-01' END AS t")
    out = P.split_by_time(df, "t", "row_id")
    counts = {r.split: (r["count"], r.lo) for r in out.groupBy("split").agg(F.count("*").alias("count"), F.min("row_id").alias("lo")).collect()}
    assert {k: v[0] for k, v in counts.items()} == {"train": 2800, "validation": 600, "test": 600}
    assert out.where("t IS NULL AND split = 'train'").count() == 0
    # rows of one time, or without one, lie in many partitions
    largest = positions(df, [F.col("t").asc_nulls_last(), F.col("row_id")]).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 2500


def test_grouped_split_needs_ten_groups_a_class(spark):
    df = spark.range(300).selectExpr("id % 100 AS n", "CASE WHEN id % 100 < 80 THEN 'a' ELSE 'b' END AS label").selectExpr("'i' || n AS identity", "label")
    out = I.grouped_split(df, every_fold=True).groupBy("label", "role").agg(F.countDistinct("identity").alias("n")).collect()
    assert {(r.label, r.role): r.n for r in out} == {(c, role): share * n for c, n in (("a", 8), ("b", 2)) for role, share in (("train", 7), ("val", 1), ("meta_known", 1), ("calibration", 1))}
    with pytest.raises(ValueError, match="b has 2"):
        I.grouped_split(df.where("label = 'a' OR identity IN ('i98', 'i99')"), every_fold=True)


def test_exact_split(spark):
    df = spark.range(103).selectExpr("id AS row_id", "CASE WHEN id < 60 THEN 'a' WHEN id < 95 THEN 'b' ELSE 'c' END AS label")
    out = I.exact_split(df, 3, {"train": 0.7, "val": 0.1, "test": 0.2}).collect()
    sizes = {}
    for r in out:
        sizes[r.role] = sizes.get(r.role, 0) + 1
    assert sizes == {"test": 21, "val": 11, "train": 71} and len({r.row_id for r in out}) == 103
    of = lambda c, role: sum(r.label == c and r.role == role for r in out)
    assert (of("a", "test"), of("b", "test"), of("c", "test")) == (12, 7, 2)
    rare = df.where("row_id < 98")  # c has three rows: labels are not looked at
    assert {r.role: r["count"] for r in I.exact_split(rare, 3, {"train": 0.8, "test": 0.2}).groupBy("role").count().collect()} == {"test": 20, "train": 78}
    assert I.exact_split(df.limit(0), 3, {"train": 0.8, "test": 0.2}).count() == 0
    assert I.shares_of({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
