"""Distances in last places, merges, root causes, and a named breach for each rule of the retraining gate."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import forensics as X
from netloom.operators import retraining as R


def test_places_of_floats(spark):
    values = [0.0, -0.0, 1.0, float(np.nextafter(np.float32(1), np.float32(2))), -1.0, 1e-45, -1e-45, float("inf"), None, float("nan"), 3.4e38]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: (r.p, r.s) for r in df.select("i", X.place(F.col("v")).alias("p"), X.spacing(F.col("v")).alias("s")).collect()}
    assert got[0][0] == got[1][0] == 0 and got[3][0] - got[2][0] == 1 and got[4][0] == -got[2][0] and (got[5][0], got[6][0]) == (1, -1)
    assert got[8] == (None, None) and got[9][0] is None and got[7][1] is None
    assert got[2][1] == 2.0**-23 and got[10][0] < got[7][0]
    row = spark.range(1).select(X.distance(F.lit(1.0), F.lit(1.0 + 3 * 2.0**-23)).alias("d")).first()
    assert row.d == 3


def test_merged_features(spark):
    up = 1.0 + 2.0**-24 * 0.5
    rows = [(1.0, 5.0, "train"), (up, 5.0, "val"), (1.0, 5.0, "train"), (2.0, 5.0, "train"), (2.0, 5.0, "val"), (-0.0, 1.0, "train"), (0.0, 1.0, "val"), (None, 1.0, "val")]
    got = X.merged_features(spark.createDataFrame(rows, "a double, b double, role string"), ["a", "b"], "role").collect()
    assert [(r.feature, r.rows, r.vectors, r.roles, r.low, r.high, r.in_last_places) for r in got] == [("a", 3, 2, ["train", "val"], 1.0, up, 0.25)]
    assert X.merged_features(spark.createDataFrame([], "a double, b double"), ["a"]).count() == 0


def test_merge_causes(spark):
    rows = [("x", 1, 1, 1), ("y", 1, 1, 1), ("z", 2, 1, 1), ("u", 3, 3, 1), ("v", 9, 9, 9), ("v", 9, 9, 9)]
    got = {r.stage: (r.groups, r.rows, r.identities) for r in X.merge_causes(spark.createDataFrame(rows, "identity string, encoded int, scaled int, single int"), ["encoded", "scaled", "single"], "identity").collect()}
    assert got == {"encoded": (1, 2, 2), "scaled": (1, 3, 3), "single": (1, 4, 4)}


def test_merges_are_told_apart_in_parts_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 50, raising=False)
    draw = np.random.default_rng(5)
    some = lambda k: None if (v := int(draw.integers(0, k))) == 0 else v
    rows = [(None if (i := some(40)) is None else f"i{i}", some(30), [0.0, -0.0, 1.5, None, 2.5][draw.integers(0, 5)], some(6)) for _ in range(1400)] + [("hot", 1, -0.0, 2)] * 600
    names, stages = ["identity", "encoded", "scaled", "single"], ["encoded", "scaled", "single"]
    want = {}
    for before, after in ((0, 1), (1, 2), (2, 3)):
        groups = {}
        for r in rows:
            n, parts, ids = groups.setdefault(r[after], ([], set(), set()))
            n.append(r), parts.add(r[before]), ids.add((r[before], r[0]))
        merged = [g for g in groups.values() if len(g[1]) > 1]
        want[names[after]] = (len(merged), sum(len(g[0]) for g in merged), sum(len(g[2]) for g in merged))
    df = spark.createDataFrame(rows, "identity string, encoded int, scaled double, single int").repartition(3)
    for held in (df, df.withColumn("scaled", F.array("scaled"))):  # nested fingerprints are not summed in batches
        out = X.merge_causes(held, stages, "identity")
        assert {r.stage: (r.groups, r.rows, r.identities) for r in out.collect()} == want
    deals = re.findall(r"direct_shuffle_partition_id\(\S+\), (\d+)\)", out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString())
    assert set(deals) == {"40"}  # 2,000 rows in parts of 50


def test_equal_rows_of_a_batch_are_one(spark):
    df = spark.range(3000, numPartitions=1).select(F.lit("a").alias("identity"), F.when(F.col("id") < 2990, 1.5).alias("v"))
    out = X._once(df, "n").collect()
    assert len(out) <= 3 and {(v, sum(r.n for r in out if r.v == v)) for v in (1.5, None)} == {(1.5, 2990), (None, 10)}


def test_root_causes(spark):
    rows = [
        (1, "a", "tcp", "x", "N"), (1, "a", "tcp", "x", "F"),  # one record, two labels
        (2, "b", "tcp", "x", "N"), (3, "b", "tcp", "x", "F"),  # one event, two records
        (4, "c", "tcp", "x", "N"), (5, "c", "TCP ", "x", "F"),  # two events by a raw category
        (6, "d", "tcp", "x", "N"), (7, "d", "tcp", "y", "N"),  # no conflict
        (8, "e", None, "x", "N"), (9, "e", "tcp", "x", "F"), (10, "f", "tcp", "x", None),
    ]
    df = spark.createDataFrame(rows, "id int, identity string, proto string, host string, label string")
    got = X.root_causes(df, ["id", "proto", "host"], ["proto", "host"], [("proto", F.lower(F.trim("proto")))]).first().asDict()
    assert got == {"conflicting_identities": 4, "affected_rows": 8, "record_conflicts": 1, "event_conflicts": 2, "one_event": 2, "projection_conflicts": 2, "category_conflicts": 1}
    assert X.root_causes(df.limit(0), ["id"], ["proto"], []).first().asDict()["conflicting_identities"] == 0


SCHEMA = "row_id long, label string, role string, source_role string, canonical string, model_input string"
TEXT = ["dur", "rate"]


def fold():
    rows, n = [], 0
    for role in R.KNOWN_ROLES:
        for label in R.KNOWN:
            for _ in range(20 if label == "Normal" else 2):
                n += 1
                rows.append([n, label, role, "official_train", f"c{n}", f"m{n}"])
    for role, label in (("surrogate_ood", "Fuzzers"), ("target", "Worms")):
        for _ in range(2):
            n += 1
            rows.append([n, label, role, "official_train", f"c{n}", f"m{n}"])
    return rows


def broken(spark, rows, features=TEXT):
    found = R.breaches(spark.createDataFrame(rows, SCHEMA), "Worms", features, TEXT).orderBy("number").collect()
    assert [r.rule for r in found] == list(R.RULES)
    assert all(bool(r.broken) == bool(r.evidence) and len(r.evidence) <= 5 for r in found)
    return {r.rule for r in found if r.broken}


def test_a_clean_fold_passes(spark):
    assert broken(spark, fold()) == set()
    assert R.require_retrainable(spark.createDataFrame(fold(), SCHEMA), "Worms", TEXT, TEXT).count() == len(fold())


def changed(at, **values):
    rows = fold()
    for k, v in values.items():
        rows[at][["row_id", "label", "role", "source_role", "canonical", "model_input"].index(k)] = v
    return rows


N_ROWS = len(fold())
CASES = [
    ("target_label_absent_from_fit", changed(30, label="Worms")), ("target_canonical_absent_from_fit", changed(0, canonical=f"c{N_ROWS}")), ("target_model_input_absent_from_fit", changed(0, model_input=f"m{N_ROWS}")),
    ("surrogate_target_canonical_absent", changed(N_ROWS - 3, canonical=f"c{N_ROWS}")), ("surrogate_target_model_input_absent", changed(N_ROWS - 3, model_input=f"m{N_ROWS}")),
    ("known_roles_row_disjoint", changed(0, row_id=40)), ("known_roles_canonical_disjoint", changed(0, canonical="c40")), ("known_roles_model_input_disjoint", changed(0, model_input="m40")),
    ("all_fit_roles_row_disjoint", changed(0, row_id=N_ROWS - 2)), ("all_fit_roles_canonical_disjoint", changed(0, canonical=f"c{N_ROWS - 2}")), ("all_fit_roles_model_input_disjoint", changed(0, model_input=f"m{N_ROWS - 2}")),
    ("official_test_excluded_from_fit", changed(3, source_role="official_test")), ("official_test_excluded_from_fit", changed(3, source_role=None)),
    ("calibration_has_no_target_equivalent_rows", [r if r[2] != "calibration" or r[1] != "DoS" else [*r[:4], f"c{N_ROWS}", r[5]] for r in fold()]),
    ("required_roles_usable", [r for r in fold() if r[2] != "surrogate_ood"]), ("required_roles_usable", [r for r in fold() if (r[1], r[2]) != ("DoS", "val")]),
    ("required_roles_usable", changed(30, label="Odd")), ("known_roles_canonical_disjoint", changed(0, canonical=None)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_each_breach_is_named(spark, case):
    rule, rows = CASES[case]
    found = broken(spark, rows)
    assert rule in found
    with pytest.raises(ValueError, match=rule):
        R.require_retrainable(spark.createDataFrame(rows, SCHEMA), "Worms", TEXT, TEXT)


def test_a_changed_schema_is_named(spark):
    assert broken(spark, fold(), ["dur", "rate", "extra"]) == {"schema_frozen"}
    assert broken(spark, fold(), ["rate", "dur"]) == {"schema_frozen"}
