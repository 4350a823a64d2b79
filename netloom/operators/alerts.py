"""Alerts: top-k, filters, correlation groups, time-window incidents, and the keyed store."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators.grouped import in_groups
from netloom.operators.staged import staged

# What alerts are correlated by, and the words that are no key.
GROUPS = {"Source IP": "src_ip", "Destination IP": "dst_ip", "Service": "service", "Classifier Class": "classifier_class", "Anomaly Family": "zero_day_family", "Batch File": "source_file_hash"}
NO_KEY = ("", "normal", *S.NULL_WORDS[1:])
SEARCHED = ("alert_id", "predicted_class", "classifier_class", "status", "source", "zero_day_family", "analyst_note")


def top_alerts(scores: DataFrame, file_hash: str, limit: int = 25) -> DataFrame:
    """The highest scored rows as alerts: anomalies first, then hybrid, reconstruction, and low confidence."""
    alert_id = F.concat(F.lit(f"BATCH-{(file_hash or 'unknown')[:8]}-"), F.lpad(F.col("source_row").cast("string"), 6, "0"))
    long_id = F.when(F.length(F.col("source_row").cast("string")) > 6, F.concat(F.lit(f"BATCH-{(file_hash or 'unknown')[:8]}-"), F.col("source_row").cast("string"))).otherwise(alert_id)
    order = [F.desc("is_zeroday"), F.desc("hybrid_score"), F.desc("ae_score"), F.asc("max_prob"), F.asc("source_row")]
    return scores.orderBy(*order).limit(limit).withColumn("alert_id", long_id).withColumn("source", F.lit("batch_top"))


def filtered(alerts: DataFrame, status: str = "All", severity: str = "All", ood: str = "All", query: str = "") -> DataFrame:
    out = alerts
    if status != "All":
        out = out.where(F.coalesce("status", F.lit("new")) == status)
    if severity != "All":
        out = out.where(F.upper(F.coalesce("llm_severity", F.lit("N/A"))) == severity.upper())
    if ood in ("OOD only", "Known only"):
        flag = F.coalesce("is_zeroday", F.lit(False))
        out = out.where(flag if ood == "OOD only" else ~flag)
    if query.strip():
        text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in SEARCHED if c in alerts.columns)))
        out = out.where(F.instr(text, query.strip().lower()) > 0)
    return out


def keyed(alerts: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """One row for each alert and correlation key it has: group_type, key and the alert's columns."""
    pairs = [F.struct(F.lit(t).alias("group_type"), F.trim(F.coalesce(F.col(c), F.lit(""))).alias("key")) for t, c in (groups or GROUPS).items() if c in alerts.columns]
    out = alerts.select("*", F.explode(F.array(*pairs)).alias("_k")).select("*", "_k.group_type", "_k.key").drop("_k")
    return out.where(~F.lower("key").isin(*NO_KEY))


def correlated(alerts: DataFrame, least: int = 2) -> DataFrame:
    """group_type, key, alert_count, ood_count, max_risk, latest_time, alert_ids (the ten first) of keys with several alerts."""
    k = keyed(alerts)
    counts = k.groupBy("group_type", "key").agg(
        F.count(F.lit(1)).alias("alert_count"), F.count_if("is_zeroday").alias("ood_count"), F.max(F.coalesce("risk", F.lit(0)).cast("double")).alias("max_risk"), F.max("timestamp").alias("latest_time")
    ).where(F.col("alert_count") >= least)
    nth = F.row_number().over(Window.partitionBy("group_type", "key").orderBy("alert_id"))
    ids = k.select("group_type", "key", "alert_id", nth.alias("n")).where("n <= 10").groupBy("group_type", "key").agg(F.array_sort(F.collect_list("alert_id")).alias("alert_ids"))
    return counts.join(ids, ["group_type", "key"]).orderBy(F.desc("alert_count"), F.desc("ood_count"), F.desc("max_risk"), "group_type", "key")


#: A span of a key's time is so many windows; spans are worked on apart.
SPAN = 96


def anchored(events: DataFrame, keys: list[str], time_us: str, tie: str, window_us: int) -> DataFrame:
    """events with cluster_start: a cluster runs while the time is within the window of its first event.

    A key's distinct times are cut into spans of SPAN windows. Each span says for every time that may start its first
    cluster where its last cluster then starts; a fold over a key's spans, a few rows each, tells which it is; then
    each span gives its starts, one a window at most, and an event looks its own up.
    """
    span = SPAN * window_us
    named = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    at = [*keys, "_span"]
    placed = events.withColumn("_span", F.floor(F.col(time_us) / span).cast("long"))
    times = placed.select(*at, F.col(time_us).cast("long").alias("_t")).distinct()

    def exits(key: tuple, columns: dict[str, np.ndarray]) -> list[tuple]:
        t = columns["_t"]
        jump = np.append(np.searchsorted(t, t + window_us, side="right"), len(t))
        last = np.arange(len(t) + 1)
        while (jump[:-1] < len(t)).any():
            last, jump = np.where(jump < len(t), last[jump], last), jump[jump]
        some = min(len(t), int(np.searchsorted(t, key[-1] * span + window_us, side="right")) + 1)
        return [(*key, t[:some].tolist(), t[last[:some]].tolist())]

    def fold(key: tuple, columns: dict[str, np.ndarray]) -> list[tuple]:
        out, anchor = [], None
        for place, first, last in zip(columns["_span"].tolist(), columns["_first"], columns["_last"], strict=True):
            out.append((*key, place, anchor))
            i = 0 if anchor is None else int(np.searchsorted(first, anchor + window_us, side="right"))
            anchor = int(last[i]) if i < len(first) else anchor
        return out

    def starts(key: tuple, columns: dict[str, np.ndarray]) -> list[tuple]:
        t, entry = columns["_t"], columns["_entry"][0]
        after = np.searchsorted(t, t + window_us, side="right")
        found = [] if entry is None or np.isnan(entry) else [int(entry)]
        i = int(np.searchsorted(t, found[0] + window_us, side="right")) if found else 0
        while i < len(t):
            found.append(int(t[i]))
            i = int(after[i])
        slots: list[int | None] = [None] * (SPAN + 1)
        for start in found:
            if (slot := start // window_us - key[-1] * SPAN + 1) >= 0:
                slots[slot] = start
        return [(*key, slots)]

    spans = in_groups(times, at, ["_t"], exits, f"{named}, _span long, _first array<long>, _last array<long>")
    entries = in_groups(spans, keys, ["_span"], fold, f"{named}, _span long, _entry long")
    listed = in_groups(times.join(entries, at), at, ["_t"], starts, f"{named}, _span long, _starts array<long>")
    joined = placed.join(listed, at)
    # starts lie more than a window apart, so that an event's is the one in its own window's slot or in the slot before
    slot = (F.floor(F.col(time_us) / window_us) - F.col("_span") * SPAN + 2).cast("int")
    own, before = F.element_at("_starts", slot), F.element_at("_starts", slot - 1)
    return joined.withColumn("cluster_start", F.when(own <= F.col(time_us), own).otherwise(before)).drop("_span", "_starts")


def top_values(rows: DataFrame, keys: list[str], values: dict[str, F.Column], top: int = 3) -> DataFrame:
    """keys and for each name the most frequent values, ties by the value; null where there are none."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.trim(F.coalesce(v, F.lit(""))).alias("v")) for n, v in values.items()))
    counts = rows.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*").where(~F.lower("v").isin(*NO_KEY)).groupBy(*keys, "name", "v").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(*keys, "name").orderBy(F.desc("n"), "v"))
    best = counts.withColumn("i", nth).where(F.col("i") <= top)
    in_order = lambda name: F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("i", "v"))))
    lists = best.groupBy(*keys).agg(*(F.transform(in_order(n), lambda s: s["v"]).alias(n) for n in values))
    return lists.select(*keys, *(F.when(F.size(n) > 0, F.col(n)).alias(n) for n in values))


def incidents(alerts: DataFrame, window_minutes: int = 15, least: int = 2, max_ids: int = 12) -> DataFrame:
    """Correlated alerts in anchored time windows as incidents. alerts: event_time (timestamp) and the alert columns."""
    if window_minutes <= 0 or least <= 0:
        raise ValueError("the window and the least number of alerts have to be positive")
    k = keyed(alerts.where("event_time IS NOT NULL"), {t: c for t, c in GROUPS.items() if t != "Batch File"})
    k = k.withColumn("t_us", F.unix_micros("event_time"))
    keys = ["group_type", "key"]
    rows = staged(anchored(k, keys, "t_us", "alert_id", window_minutes * 60_000_000))  # read three times below
    by = [*keys, "cluster_start"]
    base = rows.groupBy(*by).agg(
        F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("alert_count"), F.count_if("is_zeroday").alias("ood_count"), F.count_if(F.col("risk") >= 70).alias("high_count"),
        F.max("risk").alias("max_risk"), F.max(S.severity_rank(F.coalesce("llm_severity", F.lit("")))).alias("_rank"),
    ).where(F.col("alert_count") >= least)
    start, end = F.timestamp_micros("cluster_start"), F.timestamp_micros("end_us")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw_id = F.concat_ws("|", "group_type", "key", iso(start), iso(end))
    named = F.when(F.col("_rank") == 4, "CRITICAL").when(F.col("_rank") == 3, "HIGH").when(F.col("_rank") == 2, "MEDIUM").when(F.col("_rank") == 1, "LOW")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("t_us", "alert_id"))
    ids = rows.select(*by, "t_us", "alert_id", nth.alias("i")).where(F.col("i") <= max_ids)
    ids = ids.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "alert_id"))), lambda s: s["alert_id"]).alias("alert_ids"))
    tops = {n: F.col(c) for c, n in (("classifier_class", "primary_classes"), ("zero_day_family", "families"), ("src_ip", "source_ips"), ("service", "services")) if c in alerts.columns}
    out = base.join(ids, by)
    out = out.join(top_values(rows, by, tops), by, "left") if tops else out
    return out.select(
        F.concat(F.lit("INC-"), F.upper(F.substring(F.sha1(raw_id.cast("binary")), 1, 10))).alias("incident_id"), *keys, F.lit(window_minutes).alias("window_minutes"),
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start_time"), F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("end_time"),
        F.round((F.col("end_us") - F.col("cluster_start")) / 60e6, 1).alias("duration_minutes"), "alert_count", "ood_count", "high_count", "max_risk",
        F.coalesce(named, S.severity_of_risk(F.col("max_risk"))).alias("severity"), *(c for c in ("primary_classes", "families", "source_ips", "services") if c in out.columns), "alert_ids",
    ).orderBy(F.desc("max_risk"), F.desc("ood_count"), F.desc("alert_count"), F.desc("end_time"), *keys)


def merged(store: DataFrame, changes: DataFrame, version: str) -> DataFrame:
    """The store after an upsert: of each alert the last version, with the created_at of the first."""
    both = store.unionByName(changes, allowMissingColumns=True)
    best = F.max_by(F.struct(*[c for c in both.columns if c not in ("alert_id", "created_at")]), F.struct(version, "updated_at"))
    return both.groupBy("alert_id").agg(F.min("created_at").alias("created_at"), best.alias("_v")).select("alert_id", "created_at", "_v.*")


def status_changed(store: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with new statuses and notes, and the ids that it does not hold. changes: alert_id, status, note, at."""
    missing = changes.join(store.select("alert_id"), "alert_id", "left_anti")
    last = F.max_by(F.struct("status", "note", "at"), "at").alias("c")
    patch = changes.groupBy("alert_id").agg(last)
    joined = store.join(patch, "alert_id", "left")
    out = joined.withColumn("status", F.coalesce("c.status", "status")).withColumn("analyst_note", F.coalesce("c.note", "analyst_note")).withColumn("updated_at", F.coalesce("c.at", "updated_at"))
    return out.drop("c"), missing


def listed(store: DataFrame, limit: int = 200, status: str | None = None) -> DataFrame:
    rows = store.where(F.col("status") == status) if status else store
    return rows.orderBy(F.desc("updated_at"), "alert_id").limit(limit)


def queue_summary(alerts: DataFrame) -> DataFrame:
    severity = F.upper(F.coalesce("llm_severity", F.lit("")))
    return alerts.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(severity.isin("CRITICAL", "HIGH")).alias("critical_high"), F.count_if("is_zeroday").alias("ood"), F.floor(F.avg("risk")).alias("mean_risk"))


def saved_events(changes: DataFrame) -> DataFrame:
    """The log entry of each saved alert: alert_id, created_at, event_type, payload_json."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    payload = F.to_json(F.struct(text("source").alias("source"), text("status").alias("status"), text("llm_severity").alias("severity")))
    return changes.select("alert_id", F.col("updated_at").alias("created_at"), F.lit("saved").alias("event_type"), payload.alias("payload_json"))


def status_events(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The log entry of each status change whose alert the store holds. changes: alert_id, status, note, at."""
    payload = F.to_json(F.struct("status", F.coalesce("note", F.lit("")).alias("analyst_note")))
    held = changes.join(store.select("alert_id"), "alert_id", "left_semi")
    return held.select("alert_id", F.col("at").alias("created_at"), F.lit("status_updated").alias("event_type"), payload.alias("payload_json"))


def require_known(missing: DataFrame) -> None:
    """Raises if there is a change to an alert that the store does not hold."""
    if unknown := missing.select("alert_id").head(5):
        raise ValueError(f"alerts not found: {', '.join(str(r['alert_id']) for r in unknown)}")
