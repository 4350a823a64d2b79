"""Choice of a scorer, ties, missing statistics, thresholds and the external run; finite transforms."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import selection as C


def test_choice_by_cell(spark):
    rows = [(1, s, a) for s, a in zip(C.SCORERS, (0.7, 0.6))] + [(2, s, 0.5) for s in C.SCORERS] + [(3, s, a) for s, a in zip(C.SCORERS, (0.5, 0.5 - 5e-13))] + [(4, s, a) for s, a in zip(C.SCORERS, (0.2, 0.9))]
    df = spark.createDataFrame(rows, "seed int, scorer string, auroc double")
    got = {r.seed: (r.selected, r.tie) for r in C.chosen(df, ["seed"]).collect()}
    near, soft = C.SCORERS[1], C.SCORERS[0]
    assert got == {1: (soft, False), 2: (near, True), 3: (near, True), 4: (near, False)}
    with pytest.raises(Exception, match="finite selection"):
        C.chosen(df.where("seed > 1 OR scorer <> 'nearest_centroid_l2'"), ["seed"]).collect()


def frame(spark):
    rows = []
    for i in range(40):
        x = [float(i % 2), 0.0]
        rows += [("train", "a" if i % 2 else "b", f"t{i}", x, [2.0, 0.0]), ("meta_known", "a", f"m{i // 2}", [x[0] + 0.1, 0.0], [2.0, 0.0]), ("calibration", "a", f"c{i}", [x[0] + i / 100, 0.0], [2.0, 0.0])]
        rows += [("surrogate_ood", "z", f"s{i}", [0.5, 2.0], [2.0, 0.0]), ("external", "a" if i < 30 else "w", f"e{i}", [0.0, 0.05 if i < 30 else 3.0], [1.0, 0.0])]
    return spark.createDataFrame([(7, *r) for r in rows], "seed int, role string, label string, identity string, representation array<double>, logits array<double>")


def test_selection_threshold_and_external_run(spark):
    scored = C.with_scores(frame(spark), ["seed"], 2)
    stats = {r.scorer: r for r in C.development(scored, ["seed"]).collect()}
    assert stats["nearest_centroid_l2"].auroc == 1 and stats["negative_max_softmax"].auroc == 0.5
    assert (stats["nearest_centroid_l2"].known_identities, stats["nearest_centroid_l2"].surrogate_identities) == (20, 40)
    choice = C.chosen(C.development(scored, ["seed"]), ["seed"])
    frozen = C.thresholds(scored, choice, ["seed"])
    row = frozen.first()
    assert (row.selected, row.calibration_rows) == ("nearest_centroid_l2", 40) and row.threshold == pytest.approx(0.39)
    out = C.external_run(scored, frozen, ["seed"], F.col("label") == "w").first()
    assert (out.rows, out.tp, out.fp, out.tn, out.fn, out.tpr, out.fpr, out.auroc) == (40, 10, 0, 30, 0, 1, 0, 1)


def test_scores_that_are_not_finite_raise(spark):
    bad = frame(spark).union(spark.createDataFrame([(7, "meta_known", "a", "x", [float("nan"), 0.0], [1.0, 1.0])], frame(spark).schema))
    with pytest.raises(Exception, match="not finite"):
        C.development(C.with_scores(bad, ["seed"], 2), ["seed"]).collect()


def test_transforms_are_finite_or_raise(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    got = [(r.scaled_a, r.single_a) for r in C.require_transformed(df, ["a"], {"a": 1.0}, {"a": 4.0}).collect()]
    assert got == [(0.0, 0.0), (0.5, 0.5)]
    for bad, scale in ((float("inf"), 1.0), (None, 1.0), (1e300, 1.0), (1e10, 1e-305)):
        with pytest.raises(Exception, match="not finite"):
            C.require_transformed(spark.createDataFrame([(bad,)], "a double"), ["a"], {"a": 0.0}, {"a": scale}).collect()
