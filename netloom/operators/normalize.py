"""Vendor flow logs to one flow schema. Which columns exist is decided on the schema; values stay in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators.running import quantiles

# The 25 core features, and the column names that vendors give each target.
CORE_FEATURES = [
    "proto", "service", "state", "dur", "sbytes", "dbytes", "spkts", "dpkts", "sload", "dload", "sttl", "dttl", "sloss", "dloss", "sintpkt",
    "dintpkt", "tcprtt", "synack", "ackdat", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
]
ALIASES = {
    "srcip": ["srcip", "src_ip", "source_ip", "source.address", "sourceip", "id.orig_h", "srcaddr", "src_addr", "client_ip", "source"],
    "dstip": ["dstip", "dst_ip", "destination_ip", "destination.address", "dest_ip", "dstaddr", "dst_addr", "id.resp_h", "server_ip", "destination"],
    "sport": ["sport", "src_port", "source_port", "source.port", "id.orig_p", "srcport", "client_port", "spt"],
    "dsport": ["dsport", "dst_port", "destination_port", "destination.port", "dest_port", "id.resp_p", "dstport", "server_port", "dpt"],
    "proto": ["proto", "protocol", "transport", "network.transport", "ip_proto"],
    "service": ["service", "app_proto", "application", "app", "protocol_name", "event_type"],
    "state": ["state", "conn_state", "tcp_state", "session_state", "action", "flow_state"],
    "dur": ["dur", "duration", "duration_sec", "elapsed", "flow_duration", "flow_duration_sec"],
    "sbytes": [
        "sbytes", "src_bytes", "bytes_src", "source.bytes", "orig_bytes", "flow.bytes_toserver", "bytes_toserver", "sent_bytes",
        "total_length_of_fwd_packets", "subflow_fwd_bytes",
    ],
    "dbytes": [
        "dbytes", "dst_bytes", "bytes_dst", "destination.bytes", "resp_bytes", "flow.bytes_toclient", "bytes_toclient", "received_bytes",
        "total_length_of_bwd_packets", "subflow_bwd_bytes",
    ],
    "spkts": ["spkts", "src_pkts", "source.packets", "orig_pkts", "flow.pkts_toserver", "pkts_toserver", "sent_pkts", "total_fwd_packets", "subflow_fwd_packets"],
    "dpkts": [
        "dpkts", "dst_pkts", "destination.packets", "resp_pkts", "flow.pkts_toclient", "pkts_toclient", "received_pkts", "total_backward_packets",
        "total_bwd_packets", "subflow_bwd_packets",
    ],
    "sttl": ["sttl", "src_ttl", "ttl", "ip_ttl", "source.ttl"],
    "dttl": ["dttl", "dst_ttl", "destination.ttl"],
    "sloss": ["sloss", "src_loss", "source.loss", "lost_src"],
    "dloss": ["dloss", "dst_loss", "destination.loss", "lost_dst"],
    "sload": ["sload", "src_load", "source.load"],
    "dload": ["dload", "dst_load", "destination.load"],
    "smeansz": ["smeansz", "src_mean_size", "source.mean_packet_size", "fwd_packet_length_mean", "avg_fwd_segment_size"],
    "dmeansz": ["dmeansz", "dst_mean_size", "destination.mean_packet_size", "bwd_packet_length_mean", "avg_bwd_segment_size"],
    "sjit": ["sjit", "src_jitter", "jitter_src"],
    "djit": ["djit", "dst_jitter", "jitter_dst"],
    "sintpkt": ["sintpkt", "src_inter_packet_time", "source.inter_packet_time", "fwd_iat_mean"],
    "dintpkt": ["dintpkt", "dst_inter_packet_time", "destination.inter_packet_time", "bwd_iat_mean"],
    "tcprtt": ["tcprtt", "tcp_rtt", "rtt", "round_trip_time"],
    "synack": ["synack", "syn_ack", "tcp_synack"],
    "ackdat": ["ackdat", "ack_data", "tcp_ackdat"],
    "ct_srv_src": ["ct_srv_src"],
    "ct_srv_dst": ["ct_srv_dst"],
    "ct_dst_ltm": ["ct_dst_ltm"],
    "ct_src_ltm": ["ct_src_ltm"],
    "ct_src_dport_ltm": ["ct_src_dport_ltm"],
    "ct_dst_sport_ltm": ["ct_dst_sport_ltm"],
    "ct_dst_src_ltm": ["ct_dst_src_ltm"],
    "stime": ["stime", "start_time", "start", "ts", "timestamp", "@timestamp", "time"],
    "ltime": ["ltime", "end_time", "end", "endtime"],
    "label": ["label", "is_attack", "event.severity"],
    "attack_cat": ["attack_cat", "attack_category", "category", "alert.signature", "signature"],
}
TOTAL_BYTES = ["bytes", "total_bytes", "flow.bytes", "network.bytes", "bytes_total"]
TOTAL_PACKETS = ["pkts", "packets", "total_pkts", "flow.pkts", "network.packets", "packets_total"]
TEXT_COLUMNS = ("srcip", "dstip", "proto", "service", "state", "attack_cat")
DEFAULTS = {"proto": "tcp", "service": "unknown", "state": "UNK", "sbytes": 0.0, "dbytes": 0.0, "spkts": 0.0, "dpkts": 0.0, "dur": 0.0}
CONTEXT_COUNTS = {
    "ct_srv_src": ("srcip", "service"), "ct_srv_dst": ("dstip", "service"), "ct_dst_ltm": ("dstip",), "ct_src_ltm": ("srcip",),
    "ct_src_dport_ltm": ("srcip", "dsport"), "ct_dst_sport_ltm": ("dstip", "sport"), "ct_dst_src_ltm": ("srcip", "dstip"),
}
#: Keys up to which the counts of a context go to all executors; with more, rows and counts are shuffled.
MOST_KEYS = 100_000


def clean_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def cleaned(df: DataFrame) -> DataFrame:
    return df.toDF(*map(clean_name, df.columns))


def first_present(columns: list[str], names: list[str]) -> str | None:
    return next((n for n in names if n in columns), None)


def detect_schema(columns: list[str]) -> str:
    """The vendor shape by its column names, the first that fits."""
    c = set(columns)
    rules = (
        ("cic_ids2017", {"flow_duration", "total_fwd_packets", "total_backward_packets"} <= c),
        ("zeek_conn", bool({"id.orig_h", "id.resp_h"} & c) or {"conn_state", "orig_bytes", "resp_bytes"} <= c),
        ("suricata_eve_flat", "alert.signature" in c or any(x.startswith("flow.") for x in c)),
        ("netflow_or_cloud_flow", bool({"srcaddr", "dstaddr"} & c)),
        ("firewall_or_flow_csv", {"src_ip", "dst_ip"} <= c or {"source_ip", "destination_ip"} <= c),
        ("unsw_nb15", {"attack_cat", "sbytes", "dbytes"} <= c),
    )
    return next((name for name, fits in rules if fits), "generic_csv")


def coverage(columns: list[str], expected: list[str] | None = None) -> tuple[float, list[str]]:
    """Share of the expected core features that are there, and those that are not."""
    wanted = [c for c in expected or CORE_FEATURES if c in CORE_FEATURES] or CORE_FEATURES
    missing = [c for c in wanted if c not in columns]
    return round(1 - len(missing) / len(wanted), 4), missing


def quality_level(covered: float | None, mapped: int) -> str:
    level = "UNKNOWN" if covered is None else "GOOD" if covered >= 0.8 else "MEDIUM" if covered >= 0.6 else "LOW"
    return "LOW" if mapped < 3 else "MEDIUM" if mapped < 5 and level == "GOOD" else level


def normalize(raw: DataFrame, expected: list[str] | None = None, scope: list[str] | None = None, keep: list[str] | None = None, context: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Flow rows in the common schema, and a report on the mapping.

    scope: columns that bound a batch; medians and counts are taken within it (all rows by default). keep: raw
    columns to carry along, under the prefix raw_. context: the context counts to add, of those that raw lacks (all by
    default); the report names them all.
    """
    df = cleaned(raw)
    have = df.columns
    col = lambda name: F.col(f"`{name}`")
    mapped = {target: src for target, names in ALIASES.items() if (src := first_present(have, names))}
    out = {target: col(src) for target, src in mapped.items()}
    derived: list[str] = []
    carried = [f"raw_{c}" for c in keep or []] + list(scope or [])

    def derive(name: str, value) -> None:
        out[name] = value
        derived.append(name)

    median = None
    if "dur" in out:
        out["dur"] = S.number(out["dur"])
        if mapped["dur"] == "flow_duration":
            derive("dur", out["dur"] / 1e6)
        else:  # exporters in milli- or microseconds, told by the median: one scalar of the batch
            median = quantiles(df.select(*(scope or []), out["dur"].alias("_d")), list(scope or []), "_d", {"_median": 0.5}).drop("n")
            out["dur"] = out["dur"] / F.when(F.col("_median") > 100000, 1e6).when(F.col("_median") > 1000, 1000.0).otherwise(1.0)
    elif "stime" in mapped and "ltime" in mapped:
        start, end = S.event_time(col(mapped["stime"])), S.event_time(col(mapped["ltime"]))
        derive("dur", F.greatest(F.coalesce((F.unix_micros(end) - F.unix_micros(start)) / 1e6, F.lit(0.0)), F.lit(0.0)))
    for a, b, names, up, down in (("sbytes", "dbytes", TOTAL_BYTES, None, None), ("spkts", "dpkts", TOTAL_PACKETS, F.ceil, F.floor)):
        source = first_present(have, names)
        if (a in out and b in out) or not source:
            continue
        total = S.number(col(source))
        if b in out:
            out[a] = F.greatest(total - S.number(out[b]), F.lit(0.0))
        elif a in out:
            out[b] = F.greatest(total - S.number(out[a]), F.lit(0.0))
        else:
            half = total * 0.5
            out[a], out[b] = (f(half).cast("double") if f else half for f in (up, down))
        derived.extend([a, b])
    for name in ("sintpkt", "dintpkt", "sjit", "djit"):
        if name in out and ("iat" in mapped.get(name, "") or mapped.get(name, "").endswith("_std")):
            derive(name, S.number(out[name]) / 1e6)
    dur = F.greatest(S.number(out["dur"]), F.lit(1e-6)) if "dur" in out else F.lit(1.0)
    for name in "sbytes dbytes spkts dpkts sload dload sttl dttl sloss dloss sintpkt dintpkt tcprtt synack ackdat".split():
        if name in out:
            out[name] = S.number(out[name])
    for side in "sd":
        size, packets = f"{side}bytes", f"{side}pkts"
        if size in out and f"{side}load" not in out:
            derive(f"{side}load", out[size] * 8.0 / dur)
        if size in out and packets in out and f"{side}meansz" not in out:
            derive(f"{side}meansz", out[size] / (out[packets] + 1e-8))
        if packets in out and f"{side}intpkt" not in out:
            derive(f"{side}intpkt", dur / F.greatest(out[packets], F.lit(1.0)))
    for name in "sttl dttl sloss dloss tcprtt synack ackdat".split():
        if name not in out:
            derive(name, F.lit(0.0))
    flags = {f: f"{f}_flag_count" for f in ("rst", "fin", "syn", "ack")}
    if "state" not in mapped and any(f in have for f in flags.values()):
        n = {f: S.number(col(c)) if c in have else F.lit(0.0) for f, c in flags.items()}
        both = (n["syn"] > 0) & (n["ack"] > 0)
        derive("state", F.when(n["rst"] > 0, "RST").when(n["fin"] > 0, "FIN").when(both, "CON").when(n["syn"] > 0, "SYN").otherwise("CON"))
    counts = {}
    for name, keys in CONTEXT_COUNTS.items():
        if name not in out:
            counts[name] = keys
            derived.append(name)
    source = df.crossJoin(F.broadcast(median)) if median is not None and not scope else df.join(median, scope) if median is not None else df
    flat = source.select(*(scope or []), *(col(c).alias(f"raw_{c}") for c in keep or []), *(c.alias(n) for n, c in out.items()))
    base = flat
    wanted = [name for name in counts if context is None or name in context]
    whole = {name: [*(scope or []), *counts[name]] for name in wanted if all(k in out for k in counts[name])}
    few = _few(df.select(*(scope or []), *(out[k].alias(k) for k in sorted({k for name in whole for k in counts[name]}))), whole)
    for name in wanted:
        if name in whole:
            flat = _with_count(flat, base, whole[name], name, name in few)
        else:
            flat = flat.withColumn(name, F.lit(1.0))
    final = {}
    for name in [c for c in flat.columns if c not in carried]:
        if name in TEXT_COLUMNS:
            text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("unknown")))
            final[name] = F.when(text == "", "unknown").otherwise(text)
        elif name == "label":
            final[name] = S.number(F.col(name)).cast("int")
        else:
            final[name] = S.number(F.col(name))
    for name, value in DEFAULTS.items():
        if name not in final:
            final[name] = F.lit(value)
            derived.append(name)
    share, missing = coverage([*final, *counts], expected)
    report = {
        "schema": detect_schema(have), "input_columns": len(have), "output_columns": len(final), "mapped_columns": mapped,
        "derived_columns": sorted(set(derived)), "missing_core_features": missing, "feature_coverage": share, "level": quality_level(share, len(mapped)),
    }
    return flat.select(*carried, *(c.alias(n) for n, c in final.items())), report


def _few(df: DataFrame, counts: dict[str, list[str]]) -> set[str]:
    """The counts that have about MOST_KEYS keys at most, told by one pass that shuffles a row a task."""
    if not counts:
        return set()
    hashed = df.select(*(F.xxhash64(*k).alias(name) for name, k in counts.items()))
    keys = hashed.agg(*(F.approx_count_distinct(name).alias(name) for name in counts)).first()
    return {name for name in counts if keys[name] <= MOST_KEYS}


def _with_count(df: DataFrame, counted: DataFrame, keys: list[str], name: str, few: bool) -> DataFrame:
    """df with the number of rows that share its keys, nulls being a key too.

    The counts are partial aggregates joined back, so that a key with a large share of all rows is no single task. Where
    keys are few, only the counts move.
    """
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name)).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(F.broadcast(sizes) if few else sizes, same, "left").drop(*(f"_k_{k}" for k in keys))


def aligned(df: DataFrame, features: list[str]) -> DataFrame:
    """Exactly the features, in order; absent ones and what is not finite become 0."""
    return df.select(*(S.finite(F.col(f)).alias(f) if f in df.columns else F.lit(0.0).alias(f) for f in features))


# Limits of an upload.
MAX_BYTES, MAX_ROWS, MAX_COLUMNS, WARN_ROWS = 200 << 20, 1_000_000, 250, 50_000


def check_upload(df: DataFrame, n_bytes: int) -> tuple[list[str], list[str]]:
    """Errors and warnings of an uploaded table."""
    names = [clean_name(c) for c in df.columns]
    rows = df.count()
    errors = []
    if n_bytes > MAX_BYTES:
        errors.append(f"larger than {MAX_BYTES} bytes")
    if rows == 0 or rows > MAX_ROWS:
        errors.append(f"{rows} rows; 1 to {MAX_ROWS} are taken")
    if len(names) > MAX_COLUMNS:
        errors.append(f"more than {MAX_COLUMNS} columns")
    if len(set(names)) < len(names):
        errors.append("columns share a name")
    if any(not n or n.startswith("unnamed") or n.startswith("_c") for n in names):
        errors.append("columns without a name")
    return errors, [f"over {WARN_ROWS} rows"] if rows > WARN_ROWS else []
