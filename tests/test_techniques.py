from netloom.operators import techniques as T


def test_known_attacks_and_anomalies(spark):
    rows = [
        (1, "DoS", False, 0.0, ["sbytes", "dur"]), (2, "Normal", False, 0.0, ["sbytes"]), (3, "Normal", True, 1.0, None),
        (4, "DoS", True, 2.0, ["ct_src_ltm", "other"]), (5, "Unlisted", False, 0.0, []),
    ]
    df = spark.createDataFrame(rows, "id long, classifier_class string, is_zeroday boolean, ae_score double, top_features array<string>")
    got = {}
    for r in T.mapped(df, "id").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.technique, round(r.confidence, 4)))
    assert got == {
        1: [("T1498", 0.86), ("T1030", 0.72), ("T1499", 0.70), ("T1132", 0.52)],
        3: [("T1190", 0.63)],
        4: [("T1046", 0.92), ("T1595", 0.90)],
        5: [("T1071", 0.62), ("T1190", 0.50)],
    }
