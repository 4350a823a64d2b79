"""Packets to bidirectional flows: idle-gap sessions, direction, features, TCP state, label intervals.

packets: capture_index, timestamp_ns, src_address, dst_address, ip_protocol, src_port, dst_port, ip_total_length,
tcp_flags. All work is keyed by the unordered endpoint pair, so a capture of any length is spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S

IDLE_NS = 60_000_000_000
# TCP flag bits, and the ordered continuous features of a flow.
FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}
CONTINUOUS = (
    "duration_seconds forward_packet_count backward_packet_count total_packet_count forward_byte_count backward_byte_count total_byte_count "
    "forward_packet_fraction forward_byte_fraction mean_packet_size_bytes forward_mean_packet_size_bytes backward_mean_packet_size_bytes packets_per_second "
    "bytes_per_second forward_packets_per_second backward_packets_per_second forward_bytes_per_second backward_bytes_per_second"
).split()
KEY = ["ip_protocol", "end_a", "end_b"]


def invalid(packets: DataFrame) -> DataFrame:
    """Packets that break a rule of the contract."""
    port = lambda c: F.col(c).between(0, 65535)
    good = (F.col("capture_index") >= 0) & (F.col("timestamp_ns") >= 0) & F.col("ip_protocol").between(0, 255) & port("src_port") & port("dst_port") & (F.col("ip_total_length") > 0)
    flags = F.col("tcp_flags").isNull() | ((F.col("ip_protocol") == 6) & F.col("tcp_flags").between(0, 255))
    return packets.where(~F.coalesce(good & flags, F.lit(False)))


def sessions(packets: DataFrame, idle_ns: int = IDLE_NS) -> DataFrame:
    """packets with end_a, end_b (the unordered pair), session, pos, forward.

    A session ends when the gap is longer than idle_ns; a gap of just idle_ns continues it. Its first packet gives
    the forward direction. Ties in time go by capture_index.
    """
    if idle_ns <= 0:
        raise ValueError("idle_ns must be positive")
    src, dst = F.struct(F.col("src_address").alias("a"), F.col("src_port").alias("p")), F.struct(F.col("dst_address").alias("a"), F.col("dst_port").alias("p"))
    keyed = packets.withColumn("end_a", F.least(src, dst)).withColumn("end_b", F.greatest(src, dst))
    order = Window.partitionBy(*KEY).orderBy("timestamp_ns", "capture_index")
    gap = F.col("timestamp_ns") - F.lag("timestamp_ns").over(order)
    numbered = keyed.withColumn("session", F.sum(F.when(gap > idle_ns, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*KEY, "session").orderBy("timestamp_ns", "capture_index")
    opener = F.first(F.struct("src_address", "src_port")).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("pos", F.row_number().over(within)).withColumn("forward", opener == F.struct("src_address", "src_port"))


def _seconds(ns) -> F.Column:
    return ns / 1_000_000_000.0


def flow_features(sessioned: DataFrame) -> DataFrame:
    """One row a flow: place, the 18 continuous features (null where a denominator is 0) and the protocol token."""
    fwd, back, size = F.col("forward"), ~F.col("forward"), F.col("ip_total_length").cast("double")
    base = sessioned.groupBy(*KEY, "session").agg(
        F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns"), F.min_by("capture_index", "pos").alias("first_index"),
        F.min_by("src_address", "pos").alias("src_address"), F.min_by("dst_address", "pos").alias("dst_address"), F.min_by("src_port", "pos").alias("src_port"), F.min_by("dst_port", "pos").alias("dst_port"),
        F.count_if(fwd).cast("double").alias("forward_packet_count"), F.count_if(back).cast("double").alias("backward_packet_count"),
        F.coalesce(F.sum(F.when(fwd, size)), F.lit(0.0)).alias("forward_byte_count"), F.coalesce(F.sum(F.when(back, size)), F.lit(0.0)).alias("backward_byte_count"),
    )
    c = F.col
    base = base.withColumn("duration_seconds", _seconds(c("end_ns") - c("start_ns")))
    base = base.withColumn("total_packet_count", c("forward_packet_count") + c("backward_packet_count")).withColumn("total_byte_count", c("forward_byte_count") + c("backward_byte_count"))
    ratios = {
        "forward_packet_fraction": ("forward_packet_count", "total_packet_count"), "forward_byte_fraction": ("forward_byte_count", "total_byte_count"),
        "mean_packet_size_bytes": ("total_byte_count", "total_packet_count"), "forward_mean_packet_size_bytes": ("forward_byte_count", "forward_packet_count"),
        "backward_mean_packet_size_bytes": ("backward_byte_count", "backward_packet_count"), "packets_per_second": ("total_packet_count", "duration_seconds"),
        "bytes_per_second": ("total_byte_count", "duration_seconds"), "forward_packets_per_second": ("forward_packet_count", "duration_seconds"),
        "backward_packets_per_second": ("backward_packet_count", "duration_seconds"), "forward_bytes_per_second": ("forward_byte_count", "duration_seconds"),
        "backward_bytes_per_second": ("backward_byte_count", "duration_seconds"),
    }
    place = ["start_ns", "end_ns", "first_index", "src_address", "src_port", "dst_address", "dst_port", "ip_protocol", "session"]
    features = [(S.ratio(c(ratios[f][0]), c(ratios[f][1])) if f in ratios else c(f)).alias(f) for f in CONTINUOUS]
    return base.select(*place, *features, S.protocol_token(c("ip_protocol")).alias("protocol_token"))


def numbered_flows(flows: DataFrame) -> DataFrame:
    """flows with flow_id by (start, first packet): ranks within a minute plus the counts of the minutes before."""
    minute = flows.withColumn("_m", F.floor(F.col("start_ns") / 60_000_000_000))
    counts = minute.groupBy("_m").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_m", (F.sum("_c").over(Window.orderBy("_m")) - F.col("_c")).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_m").orderBy("start_ns", "first_index")) + F.col("_before") - 1
    return minute.join(starts, "_m").withColumn("flow_id", F.format_string("flow-%012d", n)).drop("_m", "_before")


def transport(sessioned: DataFrame) -> DataFrame:
    """One row a flow: inter-arrival means and deviations, flag counts, handshake times, connection state."""
    key = [*KEY, "session"]
    order = Window.partitionBy(*key).orderBy("pos")
    aside = Window.partitionBy(*key, "forward").orderBy("pos")
    ns = F.col("timestamp_ns")
    gaps = sessioned.withColumn("iat", _seconds(ns - F.lag("timestamp_ns").over(order))).withColumn("side_iat", _seconds(ns - F.lag("timestamp_ns").over(aside)))
    has = lambda m: S.has_flag(F.col("tcp_flags"), m)
    tcp, fwd = F.col("ip_protocol") == 6, F.col("forward")
    # the three steps in order: each the first of its kind after the one before
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = gaps.withColumn("syn_pos", F.min(F.when(tcp & fwd & has(2) & ~has(16), F.col("pos"))).over(upto))
    steps = steps.withColumn("synack_pos", F.min(F.when((F.col("pos") > F.col("syn_pos")) & ~fwd & has(2) & has(16), F.col("pos"))).over(upto))
    steps = steps.withColumn("ack_pos", F.min(F.when((F.col("pos") > F.col("synack_pos")) & fwd & has(16) & ~has(2), F.col("pos"))).over(upto))
    at = lambda step: F.min(F.when(F.col("pos") == F.col(step), ns))
    spread = lambda x, when: F.when(F.count(F.when(when, x)) >= 2, F.stddev_pop(F.when(when, x)))
    every, ahead, back = F.lit(True), fwd, ~fwd
    out = steps.groupBy(*key).agg(
        F.min("timestamp_ns").alias("start_ns"), F.min_by("capture_index", "pos").alias("first_index"),
        F.avg("iat").alias("flow_iat_mean_seconds"), spread(F.col("iat"), every).alias("flow_iat_std_seconds"),
        F.avg(F.when(ahead, F.col("side_iat"))).alias("forward_iat_mean_seconds"), spread(F.col("side_iat"), ahead).alias("forward_iat_std_seconds"),
        F.avg(F.when(back, F.col("side_iat"))).alias("backward_iat_mean_seconds"), spread(F.col("side_iat"), back).alias("backward_iat_std_seconds"),
        *(F.count_if(tcp & has(bit)).alias(f"tcp_{name}_count") for name, bit in FLAGS.items()),
        at("syn_pos").alias("syn"), at("synack_pos").alias("synack"), at("ack_pos").alias("ack"),
        F.max(has(4)).alias("any_rst"), F.max(has(1) & fwd).alias("fin_f"), F.max(has(1) & ~fwd).alias("fin_b"), F.max(has(2)).alias("any_syn"),
    )
    c = F.col
    state = (
        F.when(c("ip_protocol") != 6, "NOT_TCP").when(c("any_rst"), "TCP_RESET").when(c("fin_f") & c("fin_b"), "TCP_CLOSED").when(c("ack").isNotNull(), "TCP_ESTABLISHED")
        .when(c("any_syn"), "TCP_PARTIAL_HANDSHAKE").otherwise("TCP_OBSERVED")
    )
    first, second = _seconds(c("synack") - c("syn")), _seconds(c("ack") - c("synack"))
    out = out.withColumn("tcp_synack_seconds", first).withColumn("tcp_ack_after_synack_seconds", second).withColumn("tcp_handshake_seconds", first + second)
    return out.withColumn("portable_connection_state", state).drop("syn", "synack", "ack", "any_rst", "fin_f", "fin_b", "any_syn")


def flow_identity(flows: DataFrame) -> DataFrame:
    """flows with the fingerprint of the continuous features and the protocol; places, times and labels stay out."""
    return flows.withColumn("identity", S.fingerprint(*(("number", F.col(f)) for f in CONTINUOUS), ("text", F.col("protocol_token"))))


def violations(flows: DataFrame) -> DataFrame:
    """rule, n: how many flows break each rule of the feature contract."""
    c = F.col
    negative = reduce(lambda a, b: a | b, [F.coalesce(c(f) < 0, F.lit(False)) for f in CONTINUOUS])
    fraction = [f for f in CONTINUOUS if f.endswith("fraction")]
    outside = reduce(lambda a, b: a | b, [F.coalesce(~c(f).between(0, 1), F.lit(False)) for f in fraction])
    rates = reduce(lambda a, b: a | b, [(c("duration_seconds") == 0) & c(f).isNotNull() for f in CONTINUOUS if f.endswith("per_second")])
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), x.alias("bad")) for n, x in (("negative", negative), ("fraction_outside", outside), ("rate_without_duration", rates))))
    return flows.select(F.explode(rules).alias("r")).groupBy("r.rule").agg(F.count_if("r.bad").alias("n"))


def join_rules(flows: DataFrame, rules: DataFrame, key: str, bucket_ns: int = 3_600_000_000_000, max_broadcast: int = 10_000) -> DataFrame:
    """key, status, source_label, portable_label, rule_ids: interval join with wildcards, ends included.

    Few rules go to all executors. Beyond max_broadcast each rule is put into the hours it spans, and flows meet the
    rules of their hour only.
    """
    c = F.col
    fields = (("ip_protocol", "rule_protocol"), ("src_address", "source_address"), ("dst_address", "destination_address"), ("src_port", "source_port"), ("dst_port", "destination_port"))
    renamed = rules.withColumnRenamed("ip_protocol", "rule_protocol").withColumnsRenamed({"start_ns": "rule_start", "end_ns": "rule_end"})
    match = (c("start_ns") >= c("rule_start")) & (c("start_ns") <= c("rule_end"))
    for flow_column, rule_column in fields:
        match = match & (c(rule_column).isNull() | (c(rule_column) == c(flow_column)))
    flows = flows.select(key, "start_ns", *(f for f, _ in fields))
    if rules.count() <= max_broadcast:
        joined = flows.join(F.broadcast(renamed), match, "left")
    else:
        hours = renamed.withColumn("_h", F.explode(F.sequence(F.floor(c("rule_start") / bucket_ns), F.floor(c("rule_end") / bucket_ns))))
        joined = flows.withColumn("_h", F.floor(c("start_ns") / bucket_ns)).join(hours, (flows[key].isNotNull()) & match & (F.floor(flows["start_ns"] / bucket_ns) == hours["_h"]), "left")
    out = joined.groupBy(key).agg(
        F.count("rule_id").alias("n"), F.countDistinct(F.when(c("rule_id").isNotNull(), F.struct("source_label", "portable_label"))).alias("kinds"),
        F.array_sort(F.collect_list("rule_id")).alias("rule_ids"), F.min("source_label").alias("sl"), F.min("portable_label").alias("pl"),
    )
    status = F.when(c("n") == 0, "UNMATCHED").when(c("kinds") == 1, "MATCHED").otherwise("AMBIGUOUS")
    one = c("kinds") == 1
    return out.select(key, status.alias("status"), F.when(one, c("sl")).alias("source_label"), F.when(one, c("pl")).alias("portable_label"), "rule_ids")
