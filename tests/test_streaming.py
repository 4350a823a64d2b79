import pandas as pd

from netloom.streaming import flows as T


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def stream(spark, tmp_path, df):
    path = str(tmp_path / "in")
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_adaptive_alerts_decide_before_updating(spark, tmp_path):
    rows = [("k", i, float(i % 5), i != 3) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, seq long, score double, normal boolean")
    got = drain(T.adaptive_alerts(stream(spark, tmp_path, df), "k", window=4, fpr=0.25), "adaptive").orderBy("seq").collect()
    held = []
    for (_, _, score, normal), r in zip(rows, got):
        threshold = float(pd.Series(held).quantile(0.75)) if held else float("inf")
        assert (r.threshold, r.alert) == (threshold, score > threshold)
        if normal:
            held = (held + [score])[-4:]


def test_incident_anchors(spark, tmp_path):
    rows = [("s", "k", f"a{i}", t) for i, t in enumerate((0, 8, 16, 20, 40))]
    df = spark.createDataFrame(rows, "group_type string, key string, alert_id string, t_us long")
    got = drain(T.incident_anchors(stream(spark, tmp_path, df), 15), "anchors").orderBy("t_us").collect()
    assert [r.anchor_us for r in got] == [0, 0, 16, 16, 40]


def test_scoring_and_sessions(spark, tmp_path):
    df = spark.createDataFrame([(0.9, 0.3, 0.8, "Normal"), (0.1, 0.9, 0.1, "Normal")], "ae_score double, max_prob double, hybrid_score double, classifier_class string")
    got = drain(T.scored(stream(spark, tmp_path, df), {"hybrid": 0.5}), "scored").orderBy("ae_score").collect()
    assert [r.predicted_class for r in got] == ["Normal", "Zero-Day Candidate"]
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:30", "2024-01-01 00:05:00"]
    p = spark.createDataFrame([(t, "k", 10) for t in times], "t string, k string, ip_total_length int").selectExpr("cast(t as timestamp) t", "k", "ip_total_length")
    out = T.sessions(p, "t", ["k"])
    assert sorted(r.packets for r in out.collect()) == [1, 2]


def test_upsert_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, "new"), ("a", 2, 2, "closed"), ("b", 1, 1, "new")], "alert_id string, created_at long, updated_at long, status string")
    q = T.upsert_into(str(tmp_path / "store"), str(tmp_path / "ck"))(stream(spark, tmp_path, df))
    q.processAllAvailable()
    q.stop()
    got = {r.alert_id: (r.created_at, r.status) for r in spark.read.parquet(str(tmp_path / "store/version=0")).collect()}
    assert got == {"a": (1, "closed"), "b": (1, "new")}
