"""Queries against their SQL on tables whose keys go beyond those of the given ones."""

import math

import duckdb
import numpy as np
import pytest

from netloom.operators import clusters as C
from netloom.operators import normalize as N
from netloom.plans import registry
from netloom.plans.frames import TABLES


@pytest.fixture
def against_sql(spark, sf, tmp_path):
    """Runs a query over tables of which some are replaced by SQL over the given ones; returns its rows and those of its SQL."""

    def run(name: str, **replaced: str) -> tuple[list, list]:
        con = duckdb.connect()
        for table in TABLES:
            con.sql(f"CREATE VIEW {table}_given AS FROM '{sf}/{table}.parquet'")
            con.sql(f"COPY ({replaced.get(table, f'FROM {table}_given')}) TO '{tmp_path}/{table}.parquet'")
            con.sql(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet'")
        want = con.sql(registry.oracle_sql()[name])
        got = registry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
        return sorted(map(tuple, got), key=str), sorted(want.fetchall(), key=str)

    return run


def test_users_beyond_16_bits(against_sql):
    got, want = against_sql("invalid_packets", events="SELECT * REPLACE (user_id + 70000 AS user_id) FROM events_given")
    assert got == want


def test_scores_that_equal_the_quantile(against_sql):
    """Streams of three scores, the last of which equals the quantile of the others but for a last bit."""
    few = "SELECT * REPLACE (event_id // 3 AS user_id, [0.03, 1.03, 0.98, 0.1, 1.1, 1.05][event_id % 6 + 1]::DOUBLE AS value) FROM events_given"
    got, want = against_sql("adaptive_threshold", events=few)
    assert got == want


def test_means_at_a_half_of_the_last_place(spark):
    """64 vectors whose mean is 0.9346875: the order and the tasks of the rows do not matter, nor copies counted once."""
    x = [0.94] * 40 + [0.92] * 23 + [59.82 - 40 * 0.94 - 23 * 0.92]
    for parts in (1, 3, 7):
        rows = spark.createDataFrame([("a", str(i), [v]) for i, v in enumerate(x * 2)], "label string, key string, x array<double>").repartition(parts)
        for held in (rows, C.once(rows)):
            out = C.step(held, {"a": np.zeros((1, 1))}).first()
            assert (out.n, out.sums[0]) == (128, math.fsum(x * 2)) and out.cost == pytest.approx(sum(v * v for v in x * 2))


def test_rows_stay_where_they_are_for_counts_of_few_keys(spark, sf, monkeypatch):
    """Only counts move, whatever Spark takes for small; with more keys rows and counts meet by a shuffle, with the same rows."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for most, joins in ((100_000, 0), (0, 3)):
            monkeypatch.setattr(N, "MOST_KEYS", most, raising=False)
            out = registry.queries()["normalize_netflow"](spark, sf)
            plan = out._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("SortMergeJoin") == joins
            found.append(sorted(map(str, out.collect())))
        assert found[0] == found[1] and len(found[0]) == 6000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_the_report_names_counts_that_are_left_out(spark):
    raw = spark.createDataFrame([("a", "b", 1)], "srcaddr string, dstaddr string, srcport int")
    (every, said), (none, told) = N.normalize(raw), N.normalize(raw, context=[])
    assert set(every.columns) - set(none.columns) == set(N.CONTEXT_COUNTS)
    assert {k: v for k, v in said.items() if k != "output_columns"} == {k: v for k, v in told.items() if k != "output_columns"}
