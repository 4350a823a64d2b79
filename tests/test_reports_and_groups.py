"""Group walks in Arrow batches and the report figures on small tables."""

import numpy as np

from netloom.operators import alerts as A
from netloom.operators import reports as R
from netloom.operators.grouped import in_groups


def test_groups_cross_batches_and_null_keys_are_a_group(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if i % 5 == 4 else f"k{i % 5}", i % 2, i) for i in range(200)]
        df = spark.createDataFrame(rows, "a string, b int, v long").repartition(3)
        work = lambda key, columns: [(*key, int(columns["v"].sum()), bool((np.diff(columns["v"]) > 0).all()))]
        got = {(r.a, r.b): (r.total, r.rising) for r in in_groups(df, ["a", "b"], ["v"], work, "a string, b int, total long, rising boolean").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for a, b, v in rows:
        want[a, b] = want.get((a, b), 0) + v
    assert got == {k: (v, True) for k, v in want.items()}
    assert in_groups(df.limit(0), ["a"], ["v"], lambda key, columns: [], "a string").count() == 0


def test_totals_of_a_report(spark):
    df = spark.createDataFrame([("Normal", "Normal"), ("Normal", "DoS"), ("DoS", "DoS"), ("Worms", "Normal")], "t string, p string")
    row = R.report_totals(df, "t", "p").first()
    assert (row.rows, row.accuracy) == (4, 0.5) and round(row.known_accuracy, 6) == round(2 / 3, 6) and round(row.macro_recall, 6) == 0.5


def test_audits(spark):
    rows = [("i1", "A", "s"), ("i1", "B", "s"), ("i1", "B", "t"), ("i2", "A", "s"), ("i3", "C", "t"), ("i3", "A", "t")]
    df = spark.createDataFrame(rows, "identity string, label string, source string")
    audit = R.identity_audit(df).first()
    assert (audit.rows, audit.identities, audit.mixed_identities, audit.mixed_rows, audit.review) == (6, 3, 2, 5, False)
    assert [(r.place, r.identity, r.rows, r.labels) for r in R.top_identities(df, 2).collect()] == [(1, "i1", 3, 2), (2, "i3", 2, 2)]
    pairs = {(r.label_a, r.label_b): (r.identities, r.rows, r.examples) for r in R.label_pair_examples(df).collect()}
    assert pairs == {("A", "B"): (1, 3, ["i1"]), ("A", "C"): (1, 2, ["i3"])}
    by = {(r.source, r.label): (r.original, r.excluded, r.kept) for r in R.ambiguity_by(df, "source").collect()}
    assert by["s", "A"] == (2, 1, 1) and by["t", "C"] == (1, 1, 0)
    empty = R.identity_audit(df.limit(0)).first()
    assert (empty.identities, empty.mixed_rows, empty.mixed_share, empty.review) == (0, 0, None, False)
    times = R.time_range(spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS t"), "t").first()
    assert (times.rows, times.timed, times.first, times.seconds) == (1, 0, None, None) or times["first"] is None


def test_groups_after_a_join_that_turns_into_a_broadcast(spark):
    """A group of times is whole in one task, however the join before it runs."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "50KB"}  # the groups fit, their times do not
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        events = spark.range(6000, numPartitions=8).selectExpr("id % 3 AS key", "(id * 7919) % 6007 * 20 AS t", "id")
        got = A.anchored(events, ["key"], "t", "id", 50).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert len(got) == 6000
    for key in range(3):
        anchor = None
        for r in sorted((r for r in got if r.key == key), key=lambda r: r.t):
            anchor = r.t if anchor is None or r.t - anchor > 50 else anchor
            assert r.cluster_start == anchor
