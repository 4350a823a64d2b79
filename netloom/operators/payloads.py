"""The 34 raw candidates of a flow from packets that keep their payload: evidence from bytes, first values a direction.

sessioned packets (flows.sessions) with ttl, tcp_seq, tcp_window and payload. A service is named only by what the
payload shows, never by a port; what cannot be verified from one flow (losses, login unless it succeeded) stays null.
A null payload is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.candidates import flow_candidates
from netloom.operators.flows import KEY

# What begins a payload of each kind, and the names of protocol numbers.
HTTP_REQUEST = r"^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE)\s+"
HTTP_RESPONSE = r"^HTTP/[0-9](\.[0-9])?\s+"
FTP_COMMAND = r"(?i)^(USER|PASS|RETR|STOR|LIST|CWD|PWD|TYPE|PORT|PASV|QUIT)\s"
FTP_SUCCESS = r"^230(\s|-)"
PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp", 58: "ipv6-icmp"}
RAW = (
    "dur", "proto", "service", "state", "spkts", "dpkts", "sbytes", "dbytes", "rate", "sttl", "dttl", "sload", "dload", "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit", "swin", "dwin", "stcpb", "dtcpb",
    "tcprtt", "synack", "ackdat", "smean", "dmean", "trans_depth", "response_body_len", "is_ftp_login", "ct_ftp_cmd", "ct_flw_http_mthd", "is_sm_ips_ports",
)


def text(payload: Column) -> Column:
    """Bytes as text, one letter a byte, for patterns over bytes."""
    return F.coalesce(F.decode(payload, "ISO-8859-1"), F.lit(""))


def with_evidence(packets: DataFrame) -> DataFrame:
    """packets with http_request, http_response, body (bytes behind a response's header), ftp_command, ftp_success."""
    t = F.col("_text")
    out = packets.withColumn("_text", text(F.col("payload")))
    out = out.withColumn("http_request", t.rlike(HTTP_REQUEST)).withColumn("http_response", t.rlike(HTTP_RESPONSE))
    split = F.instr(t, "\r\n\r\n")
    out = out.withColumn("body", F.when(F.col("http_response") & (split > 0), F.length(t) - split - 3).otherwise(0))
    return out.withColumn("ftp_command", t.rlike(FTP_COMMAND)).withColumn("ftp_success", t.rlike(FTP_SUCCESS)).drop("_text")


def raw_candidates(sessioned: DataFrame) -> DataFrame:
    """One row a flow: its key, session, first_index and the candidates of RAW, in that order."""
    seen = with_evidence(sessioned)
    c = F.col
    order = Window.partitionBy(*KEY, "session").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    flags = F.coalesce("tcp_flags", F.lit(0))
    has = lambda m: flags.bitwiseAND(F.lit(m)) == m
    tcp, fwd = c("ip_protocol") == 6, c("forward")
    steps = seen.withColumn("_syn", F.min(F.when(tcp & fwd & has(2) & ~has(16), c("pos"))).over(upto))
    steps = steps.withColumn("_both", F.min(F.when((c("pos") > c("_syn")) & ~fwd & has(18), c("pos"))).over(upto))
    steps = steps.withColumn("_ack", F.min(F.when((c("pos") > c("_both")) & fwd & has(16) & ~has(2), c("pos"))).over(upto))
    at = lambda step: F.min(F.when(c("pos") == c(step), c("timestamp_ns")))
    first = lambda name, side: F.min_by(name, F.when((fwd if side else ~fwd) & c(name).isNotNull(), c("pos")))
    total = lambda side: F.coalesce(F.sum(F.when(fwd if side else ~fwd, c("ip_total_length").cast("long"))), F.lit(0).cast("long"))
    count = lambda name: F.count_if(c(name))
    flows = steps.groupBy(*KEY, "session").agg(
        F.min_by("capture_index", "pos").alias("first_index"), F.min_by(F.struct("src_address", "src_port", "dst_address", "dst_port"), "pos").alias("_ends"),
        ((F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9).alias("dur"), count("forward").alias("spkts"), F.count_if(~fwd).alias("dpkts"), total(True).alias("sbytes"), total(False).alias("dbytes"),
        *(first(name, side).alias(f"{'s' if side else 'd'}{short}") for name, short in (("ttl", "ttl"), ("tcp_window", "win"), ("tcp_seq", "tcpb")) for side in (True, False)),
        at("_syn").alias("_syn"), at("_both").alias("_both"), at("_ack").alias("_ack"),
        count("http_request").alias("ct_flw_http_mthd"), count("http_response").alias("_responses"), F.sum("body").cast("long").alias("response_body_len"), count("ftp_command").alias("ct_ftp_cmd"), F.max("ftp_success").alias("_login"),
    )
    gaps = flow_candidates(sessioned).select(*KEY, "session", c("source_iat_ms").alias("sinpkt"), c("destination_iat_ms").alias("dinpkt"), c("source_jitter_ms").alias("sjit"), c("destination_jitter_ms").alias("djit"), c("local_state").alias("state"))
    out = flows.join(gaps, [*KEY, "session"])
    over = lambda x: F.when(c("dur") > 0, x / c("dur"))
    name = F.concat(F.lit("ip-"), c("ip_protocol").cast("string"))
    for number, known in PROTOCOLS.items():
        name = F.when(c("ip_protocol") == number, known).otherwise(name)
    out = out.withColumn("proto", name).withColumn("rate", over(c("spkts") + c("dpkts"))).withColumn("sload", over(8.0 * c("sbytes"))).withColumn("dload", over(8.0 * c("dbytes")))
    http, ftp = (c("ct_flw_http_mthd") > 0) | (c("_responses") > 0), (c("ct_ftp_cmd") > 0) | c("_login")
    out = out.withColumn("service", F.when(http, "http").when(ftp, "ftp")).withColumn("trans_depth", F.least("ct_flw_http_mthd", "_responses")).withColumn("is_ftp_login", F.when(c("_login"), F.lit(True)))
    out = out.withColumn("synack", (c("_both") - c("_syn")) / 1e9).withColumn("ackdat", (c("_ack") - c("_both")) / 1e9).withColumn("tcprtt", c("synack") + c("ackdat"))
    out = out.withColumn("smean", F.try_divide(c("sbytes"), c("spkts"))).withColumn("dmean", F.try_divide(c("dbytes"), c("dpkts")))
    out = out.withColumn("sloss", F.lit(None).cast("long")).withColumn("dloss", F.lit(None).cast("long"))
    same = (c("_ends.src_address") == c("_ends.dst_address")) & (c("_ends.src_port") == c("_ends.dst_port"))
    return out.withColumn("is_sm_ips_ports", same.cast("int")).select(*KEY, "session", "first_index", *RAW)
