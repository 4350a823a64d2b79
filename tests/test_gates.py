"""Gates on small frames."""

import pytest

from netloom.operators import gates as G


def test_roles(spark):
    df = spark.createDataFrame([("train",), ("train",)], "role string")
    assert G.require_roles(df, "gradient_fit").count() == 2
    with_null = df.union(spark.createDataFrame([(None,)], "role string"))
    for rows, operation in ((df, "threshold_fit"), (df, "final_external_evaluation"), (df, "unknown"), (with_null, "gradient_fit"), (df.limit(0), "unknown")):
        with pytest.raises(PermissionError):
            G.require_roles(rows, operation)


def test_scope_and_clean(spark):
    packets = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "c"), (None, "a")], "src_address string, dst_address string")
    assert G.outside_scope(packets, "a", "b").count() == 3
    rows = spark.createDataFrame([(1, float("inf")), (1, float("-inf")), (1, None), (1, 2.0), (1, 2.0)], "k int, x double")
    assert sorted(map(tuple, G.clean(rows).collect()), key=str) == [(1, 2.0), (1, None)]


@pytest.mark.parametrize("coverage,rates,warns,level", [
    (0.9, (0.1, 0.1), False, "LOW"), (0.7, (None, 0.1), False, "MEDIUM"), (0.5, (0.1, 0.1), False, "MEDIUM"), (0.5, (0.1, 0.1), True, "HIGH"),
    (None, (0.1, 0.1), True, "MEDIUM"), (0.9, (0.1, 0.3), True, "HIGH"), (0.9, (0.1, 0.1), True, "MEDIUM"),
])
def test_drift_level(spark, coverage, rates, warns, level):
    drift = spark.createDataFrame([("ae", "p95", warns), ("ae", "mean", False)], "name string, stat string, warn boolean")
    row = G.drift_level(drift, coverage, *rates).first()
    assert row["level"] == level and ("p95 of ae" in row["warnings"]) == warns
