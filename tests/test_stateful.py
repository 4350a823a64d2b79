"""Streams with state: logs, restarts from the checkpoint, sliding quantiles, incidents closed by timers."""

import time
from datetime import datetime, timedelta

import pandas as pd
import pytest

from netloom.streaming import stateful as S

CHANGES = "alert_id string, kind string, at long, status string, note string, body string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def source(spark, tmp_path, schema):
    (tmp_path / "in").mkdir(exist_ok=True)
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drain(df, tmp_path):
    """Runs what is there, as a query that starts from its checkpoint, and returns all rows written so far."""
    q = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()


def test_alert_log_and_restart(spark, tmp_path):
    put(spark, tmp_path, [("a", "save", 1, None, None, "{}"), ("a", "status", 3, "closed", "done", None), ("b", "status", 1, "closed", None, None), ("a", "save", None, None, None, None)], CHANGES)
    log = lambda: S.alert_log(source(spark, tmp_path, CHANGES))
    first = [(r.alert_id, r.at, r.event_type, r.status) for r in drain(log(), tmp_path)]
    assert sorted(first) == [("a", 1, "saved", "new"), ("a", 3, "status_updated", "closed"), ("b", 1, "unknown_alert", "closed")]
    assert len(drain(log(), tmp_path)) == 3  # a restart with nothing new repeats nothing
    put(spark, tmp_path, [("a", "save", 2, "new", None, "{1}"), ("a", "save", 5, "new", None, "{2}"), ("a", "status", 6, "closed", "done", None), ("b", "save", 7, None, None, "{}")], CHANGES)
    more = sorted((r.alert_id, r.at, r.event_type, r.status, r.note) for r in drain(log(), tmp_path))
    # the older save is passed over, the newer keeps the analyst's status, a status that changes nothing gives no entry
    assert more == sorted([("a", 1, "saved", "new", ""), ("a", 3, "status_updated", "closed", "done"), ("b", 1, "unknown_alert", "closed", None), ("a", 5, "saved", "closed", "done"), ("b", 7, "saved", "new", "")])


def test_sliding_quantiles(spark, tmp_path):
    schema = "k string, seq long, score double, normal boolean"
    rows = [("k", i, float((i * 7) % 11), i % 5 != 3) for i in range(40)] + [("n", 0, None, True), ("n", 1, 1.0, True)]
    put(spark, tmp_path, rows[:25], schema)
    alerts = lambda: S.sliding_alerts(source(spark, tmp_path, schema), "k", window=6, fpr=0.2)
    drain(alerts(), tmp_path)
    put(spark, tmp_path, rows[25:], schema)
    got = {(r.k, r.seq): r for r in drain(alerts(), tmp_path)}
    held = []
    for _, seq, score, normal in rows[:40]:
        threshold = float(pd.Series(held).quantile(0.8)) if held else float("inf")
        r = got["k", seq]
        assert r.threshold == pytest.approx(threshold) and r.alert == (score > threshold)
        if normal:
            held = (held + [score])[-6:]
    assert got["n", 1].threshold == float("inf") and not got["n", 0].alert


def test_labels_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="label"):
        S.sliding_alerts(source(spark, tmp_path, "k string, seq long, score double, normal boolean, label string"), "k")


def test_a_row_costs_less_than_its_window():
    ring = S.SlidingQuantile(100_000, 0.01, "k")

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Map:
        def __init__(self):
            self.d, self.written = {}, 0

        def iterator(self):
            return ((k, v) for k, v in self.d.items())

        def updateValue(self, k, v):
            self.d[k], self.written = v, self.written + 1

    ring.ring, ring.seen = Map(), Value()
    frame = pd.DataFrame({"seq": range(200_000), "score": [(i * 7919) % 100_003 / 1e5 for i in range(200_000)], "normal": True})
    list(ring.handleInputRows(("k",), iter([frame]), None))
    written, began = ring.ring.written, time.perf_counter()
    list(ring.handleInputRows(("k",), iter([frame.iloc[:1000]]), None))
    assert ring.ring.written - written == 1000 and time.perf_counter() - began < 2


def test_incidents_close_by_event_time(spark, tmp_path):
    schema = "key string, t timestamp"
    at = lambda *minutes: [("k", datetime(2024, 1, 1) + timedelta(minutes=m)) for m in minutes]
    put(spark, tmp_path, at(0, 5, 15, 16, 20), schema)
    out = lambda: S.closed_incidents(source(spark, tmp_path, schema), 900_000, "1 minute")
    drain(out(), tmp_path)
    put(spark, tmp_path, at(60), schema)
    drain(out(), tmp_path)
    put(spark, tmp_path, at(61), schema)
    got = sorted(((r.end_ms - r.start_ms) // 60_000, r.alerts) for r in drain(out(), tmp_path))
    assert got == [(4, 2), (15, 3)]
