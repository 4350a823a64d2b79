"""Stateful operators on transformWithState: an alert store with its change log, sliding quantiles, closed incidents.

State is typed and kept per key in RocksDB (`use_rocksdb`), so that a batch reads and writes the state of the keys it
has, never the whole store. A query that starts again from its checkpoint goes on where it stopped and repeats nothing.

Nulls: rows without a key are a key of their own; rows without a time or a score change no state. Repeated rows are
applied once for each occurrence, except that a save or a status that changes nothing writes no entry.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns that carry the truth: a detector that reads them would learn from what it is to find.
TRUTH = ("label", "attack_cat", "label_binary", "truth")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def require_label_free(df: DataFrame, names: tuple[str, ...] = TRUTH) -> DataFrame:
    """df, if it carries no column of the truth; raises else."""
    found = [c for c in df.columns if c.lower() in names]
    if found:
        raise ValueError(f"a benchmark's threshold must not be fed by labels: {', '.join(found)}")
    return df


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


ENTRY = "alert_id string, at long, event_type string, status string, note string, payload_json string"


class AlertStore(StatefulProcessor):
    """The current alert of each id. Saves and status changes come in order of their time; each that changes something
    gives one entry of the log. The first save's time is kept as created_at; later saves keep a status that an analyst
    set. A change to an id that was never saved gives an entry of type unknown_alert and no state."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = _struct(created_at=T.LongType(), updated_at=T.LongType(), status=T.StringType(), note=T.StringType(), body=T.StringType(), triaged=T.BooleanType())
        self.held = handle.getValueState("alert", row, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.held.get() if self.held.exists() else None
        out, changed = [], False
        frames = [f for f in rows if len(f)]
        frame = pd.concat(frames).sort_values(["at", "kind"], kind="stable") if frames else pd.DataFrame(columns=["at"])
        for r in frame[frame["at"].notna()].itertuples(index=False):
            status, note = (v if isinstance(v, str) else None for v in (r.status, r.note))
            at = int(r.at)
            if r.kind == "save":
                body = r.body if isinstance(r.body, str) else "{}"
                if now is None:
                    new = (at, at, status or "new", note or "", body, False)
                elif at < now[1]:
                    continue  # an older save than what is held
                else:
                    new = (now[0], at, now[2] if now[5] else status or now[2], note or now[3], body, now[5])
                if now is None or new[2:] != tuple(now)[2:]:
                    out.append((key[0], at, "saved", new[2], new[3], json.dumps({"status": new[2], "first": now is None}, sort_keys=True)))
                now, changed = new, True
            elif now is None:
                out.append((key[0], at, "unknown_alert", status, note, "{}"))
            elif at >= now[1] and (status or now[2], note or now[3]) != (now[2], now[3]):
                now, changed = (now[0], at, status or now[2], note or now[3], now[4], True), True
                out.append((key[0], at, "status_updated", now[2], now[3], json.dumps({"analyst_note": now[3], "status": now[2]}, sort_keys=True)))
        if changed:
            self.held.update(tuple(now))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRY.split(", ")])

    def close(self) -> None:
        pass


def alert_log(changes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The change log of a stream of changes: alert_id, kind (save or status), at, status, note, body."""
    keyed = changes.select("alert_id", "kind", "at", "status", "note", "body").groupBy("alert_id")
    return keyed.transformWithStateInPandas(AlertStore(ttl_ms), ENTRY, "append", "processingTime" if ttl_ms else "none")


class SlidingQuantile(StatefulProcessor):
    """The last scores of a key as a ring of slots, and beside it, for the batch, the same scores in order.

    A batch reads the ring once and writes only the slots that its rows filled; a row costs a search and an insertion
    in the ordered list. A decision comes before its score enters.
    """

    def __init__(self, window: int, fpr: float, key: str):
        self.window, self.fpr, self.key = window, fpr, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", _struct(slot=T.IntegerType()), _struct(score=T.DoubleType()))
        self.seen = handle.getValueState("seen", _struct(n=T.LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        slots = {k[0]: v[0] for k, v in self.ring.iterator()} if seen else {}
        ordered, filled, out = sorted(slots.values()), {}, []
        frames = [f for f in rows if len(f)]
        frame = pd.concat(frames).sort_values("seq", kind="stable") if frames else pd.DataFrame(columns=["seq", "score", "normal"])
        for r in frame.itertuples(index=False):
            threshold = quantile(ordered, 1 - self.fpr)
            out.append((key[0], r.seq, r.score, threshold, bool(r.score > threshold)))
            if not r.normal or pd.isna(r.score):
                continue
            slot = seen % self.window
            if slot in slots:
                del ordered[bisect.bisect_left(ordered, slots[slot])]
            slots[slot] = filled[slot] = float(r.score)
            bisect.insort(ordered, float(r.score))
            seen += 1
        for slot, score in filled.items():
            self.ring.updateValue((slot,), (score,))
        self.seen.update((seen,))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "seq", "score", "threshold", "alert"])

    def close(self) -> None:
        pass


def quantile(ordered: list[float], q: float) -> float:
    """Linear between neighbours; infinite for no values."""
    if not ordered:
        return float("inf")
    place = (len(ordered) - 1) * q
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)


def sliding_alerts(scores: DataFrame, key: str, window: int = 1000, fpr: float = 0.01) -> DataFrame:
    """key, seq, score, threshold, alert: each score against the quantile of the `window` normal scores before it.

    scores: key, seq, score, normal (what the detector itself decided); columns of the truth raise.
    """
    require_label_free(scores)
    kind = dict(scores.dtypes)[key]
    keyed = scores.select(key, "seq", "score", "normal").groupBy(key)
    return keyed.transformWithStateInPandas(SlidingQuantile(window, fpr, key), f"{key} {kind}, seq long, score double, threshold double, alert boolean", "append", "none")


class Incidents(StatefulProcessor):
    """An incident begins with an alert and takes in those within the window after it; it is given once, when event time
    has passed its window, by a timer, and its state goes with it."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", _struct(start=T.LongType()), _struct(last=T.LongType(), alerts=T.LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t.timestamp() * 1000 + 0.5) for f in rows for t in f["t"] if not pd.isna(t))
        held = {k[0]: list(v) for k, v in self.open.iterator()}
        for t in times:
            start = next((s for s in held if s <= t <= s + self.window_ms), None)
            if start is None:
                start = t
                held[t] = [t, 0]
                self.handle.registerTimer(t + self.window_ms + 1)
            held[start] = [max(held[start][0], t), held[start][1] + 1]
        for start, (last, alerts) in held.items():
            self.open.updateValue((start,), (last, alerts))
        yield pd.DataFrame({"key": pd.Series(dtype=object), "start_ms": pd.Series(dtype="int64"), "end_ms": pd.Series(dtype="int64"), "alerts": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.window_ms - 1
        if self.open.containsKey((start,)):
            last, alerts = self.open.getValue((start,))
            self.open.removeKey((start,))
            yield pd.DataFrame({"key": [key[0]], "start_ms": [start], "end_ms": [last], "alerts": [alerts]})

    def close(self) -> None:
        pass


def closed_incidents(alerts: DataFrame, window_ms: int = 900_000, late: str = "10 minutes") -> DataFrame:
    """key, start_ms, end_ms, alerts of incidents whose window has passed. alerts: key, t (timestamp)."""
    keyed = alerts.select("key", "t").withWatermark("t", late).groupBy("key")
    return keyed.transformWithStateInPandas(Incidents(window_ms), "key string, start_ms long, end_ms long, alerts long", "append", "eventTime")
