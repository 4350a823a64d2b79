"""Edge rows of the display tables."""

from netloom.operators import displays as D
from netloom.operators import flows


def test_history_defaults_and_order(spark):
    rows = [("a", "t1", 0.2, True, "x"), ("b", "t2", 0.2, True, "x"), ("c", "t0", 0.90049, False, "y")]
    got = D.history(spark.createDataFrame(rows, "alert_id string, timestamp string, hybrid_score double, is_zeroday boolean, predicted_class string")).collect()
    assert [r.alert_id for r in got] == ["c", "b", "a"]
    assert (got[0].status, got[0].source, got[0].severity, got[0].hybrid_score, got[0].ae_score, got[0].risk) == ("new", "session", "N/A", 0.9, 0.0, 51)


def test_long_table(spark):
    df = spark.createDataFrame([(1, "x", None)], "row_id long, name string, Size double")
    assert [(r["rank"], r.feature, r.value) for r in D.long_table(df, "row_id", ["name", "Size"], ("Size",)).collect()] == [(0, "Size", None), (1, "name", "x")]
    assert [r.feature for r in D.long_table(df, "row_id", ["name", "Size"], search="size").collect()] == ["Size"]
    assert D.long_table(df, "row_id", ["name"], search="none").count() == 0


def test_enriched_keeps_given_detection(spark):
    rows = [("kept", None, "Worms"), ("", None, "Normal"), (None, "DoS", "Normal")]
    got = D.enriched(spark.createDataFrame(rows, "detection string, classifier_class string, predicted_class string")).collect()
    assert [(r.detection, r.classifier_class, r.risk) for r in got] == [("kept", "Worms", 15), ("Normal", "Normal", 15), ("Known-Attack", "DoS", 15)]


def test_relabelled_and_numeric_features(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "t", 3, 4)], "v string, b long, a double, proto_num string, _meta int, label int")
    assert D.numeric_features(df, ("label",)) == ["a", "b", "proto_num"]
    assert [r[0] for r in df.select(D.relabelled(df.v, {"a": "Anomaly", "b": "Benign"})).collect()] == ["Anomaly"]
    assert [r[0] for r in df.select(D.relabelled(df.v, {"x": "Anomaly"})).collect()] == ["a"]


def test_ranked_methods_ties_and_missing(spark):
    rows = [(0, "zero", 0.0, 0.5, 0.1), (1, "null", None, 0.5, 0.1), (2, "best", 0.9, 0.5, 0.0), (3, "good", 0.9, 0.5, 0.2)]
    got = D.ranked_methods(spark.createDataFrame(rows, "p int, method string, auroc double, ood_detection_rate double, normal_fpr double"), "p").orderBy("rank").collect()
    assert [r.method for r in got] == ["good", "best", "zero", "null"]  # a rate of 0 counts as 1


def test_top_attributions_ties_and_missing_names(spark):
    df = spark.createDataFrame([([1.0, -3.0, 3.0, 0.5], [7.0, 8.0])], "shap array<double>, raw array<double>")
    got = D.top_attributions(df, ["a", "b"], "shap", "raw", 3).first().top_features
    assert [tuple(e) for e in got] == [("feat_2", 3.0, 0.0), ("b", -3.0, 8.0), ("a", 1.0, 7.0)]


def test_schedule_feeds_the_rule_join(spark):
    schedule = spark.sql("SELECT array(named_struct('scenario_id', 's1', 'expected_start_ns', 10, 'expected_end_ns', 20, 'scenario_type', 'scan', 'portable_label', 'ATTACK', 'target_host', 'h')) AS scenarios")
    packets = spark.createDataFrame([(1, 15, 6, "g", "h", 1, 2), (2, 25, 6, "g", "h", 1, 2), (3, 15, 6, "g", "other", 1, 2)], "k long, start_ns long, ip_protocol int, src_address string, dst_address string, src_port int, dst_port int")
    got = {r.k: r.status for r in flows.join_rules(packets, D.schedule_rules(schedule), "k").collect()}
    assert got == {1: "MATCHED", 2: "UNMATCHED", 3: "UNMATCHED"}
