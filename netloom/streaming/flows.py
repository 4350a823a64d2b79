"""Structured Streaming: scoring of single events, idle-gap sessions, sliding thresholds, incidents, a keyed store."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netloom.functions import scalars as S
from netloom.streaming.stateful import quantile


def scored(events: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Each event on its own: anomaly flag, verdict and risk. Stateless, for batches and streams alike."""
    c = F.col
    flag, rule = S.anomaly_decision(c("ae_score"), c("max_prob"), c("hybrid_score"), thresholds)
    out = events.withColumn("is_zeroday", flag).withColumn("rule", F.lit(rule))
    out = out.withColumn("predicted_class", S.verdict(c("is_zeroday"), c("classifier_class")))
    return out.withColumn("risk", S.risk_score(c("hybrid_score"), c("ae_score"), c("is_zeroday"), F.lit("")))


def sessions(packets: DataFrame, time: str, keys: list[str], gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """keys, start, end, packets, bytes of sessions by idle gap. Packets later than the watermark are dropped, which
    the batch operator, that sorts all of its input, never does."""
    session = F.session_window(time, gap)
    out = packets.withWatermark(time, late).groupBy(*keys, session.alias("s")).agg(F.count(F.lit(1)).alias("packets"), F.sum("ip_total_length").alias("bytes"))
    return out.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "packets", "bytes")


def adaptive_alerts(scores: DataFrame, key: str, window: int = 1000, fpr: float = 0.01) -> DataFrame:
    """key, seq, score, threshold, alert: each score against the quantile of the `window` normal scores before it.

    The state of a key is its last scores, bounded by the window. A decision comes before its score enters the
    state, and only normal rows enter. scores: key, seq, score, normal.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else [])
        ordered = sorted(held)  # beside the scores in their sequence, for this batch
        for frame in frames:
            rows = []
            for row in frame.sort_values("seq").itertuples(index=False):
                threshold = quantile(ordered, 1 - fpr)
                rows.append((k[0], row.seq, row.score, threshold, bool(row.score > threshold)))
                if row.normal and pd.notna(row.score):
                    held.append(float(row.score))
                    bisect.insort(ordered, held[-1])
                    if len(held) > window:
                        del ordered[bisect.bisect_left(ordered, held.popleft())]
            yield pd.DataFrame(rows, columns=[key, "seq", "score", "threshold", "alert"])
        state.update((list(held),))

    kind = dict(scores.dtypes)[key]
    return scores.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, score double, threshold double, alert boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def incident_anchors(alerts: DataFrame, window_us: int = 900_000_000) -> DataFrame:
    """group_type, key, alert_id, t_us, anchor_us: alerts in order of arrival, each with the start of its window.

    The state of a key is the anchor. alerts: group_type, key, alert_id, t_us.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor = state.get[0] if state.exists else None
        for frame in frames:
            rows = []
            for row in frame.sort_values(["t_us", "alert_id"]).itertuples(index=False):
                if anchor is None or row.t_us - anchor > window_us:
                    anchor = int(row.t_us)
                rows.append((*k, row.alert_id, row.t_us, anchor))
            yield pd.DataFrame(rows, columns=["group_type", "key", "alert_id", "t_us", "anchor_us"])
        state.update((anchor,))

    schema = "group_type string, key string, alert_id string, t_us long, anchor_us long"
    return alerts.groupBy("group_type", "key").applyInPandasWithState(step, schema, "anchor long", "append", GroupStateTimeout.NoTimeout)


def upsert_into(path: str, checkpoint: str):
    """A function that starts a stream of alerts into a versioned store: each batch is written as a new version under
    the path, once for each batch number, so that a repeated batch changes nothing."""
    from netloom.operators.alerts import merged

    def batch(changes: DataFrame, number: int) -> None:
        spark = changes.sparkSession
        target = f"{path}/version={number}"
        if number == 0:
            empty = changes.limit(0)
            store = empty
        else:
            store = spark.read.parquet(f"{path}/version={number - 1}")
        merged(store, changes, "updated_at").write.mode("overwrite").parquet(target)

    return lambda alerts: alerts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").start()
