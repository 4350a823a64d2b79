"""Named queries on normalisation, labels, features, packets and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators import flows as P
from netloom.operators import labels as L
from netloom.operators import normalize as N
from netloom.operators import production as C
from netloom.plans.base import Query, adder, joined, r6

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)


@query("normalize_netflow", "flows", sql="""
, med AS (SELECT quantile_cont(dur * 2000, 0.5) AS m FROM flows),
base AS (SELECT row_id, srcip, dstip, sport, dsport, coalesce(trim(proto), 'unknown') AS proto, coalesce(service, 'unknown') AS service,
  dur * 2000 / (SELECT CASE WHEN m > 100000 THEN 1e6 WHEN m > 1000 THEN 1000 ELSE 1 END FROM med) AS dur, (sbytes + dbytes) * 0.5 AS sbytes, (sbytes + dbytes) * 0.5 AS dbytes,
  ceil((spkts + dpkts) * 0.5) AS spkts, floor((spkts + dpkts) * 0.5) AS dpkts FROM flows),
b2 AS (SELECT *, greatest(dur, 1e-6) AS d FROM base)
SELECT row_id, srcip, dstip, proto, service, round(dur, 6) AS dur, round(sbytes, 6) AS sbytes, round(dbytes, 6) AS dbytes, spkts, dpkts, round(sbytes * 8 / d, 4) AS sload, round(dbytes * 8 / d, 4) AS dload,
  round(sbytes / (spkts + 1e-8), 6) AS smeansz, round(d / greatest(spkts, 1), 6) AS sintpkt, 0.0::DOUBLE AS sttl, 'UNK' AS state,
  count(*) OVER (PARTITION BY srcip, service)::DOUBLE AS ct_srv_src, count(*) OVER (PARTITION BY dstip, sport)::DOUBLE AS ct_dst_sport_ltm, count(*) OVER (PARTITION BY srcip, dstip)::DOUBLE AS ct_dst_src_ltm
FROM b2""")
def normalize_netflow(flows: DataFrame) -> DataFrame:
    c = F.col
    raw = flows.select(c("row_id").alias("Row Id"), c("srcip").alias("SrcAddr"), c("dstip").alias("DstAddr"), c("sport").alias("srcport"), c("dsport").alias("dstport"), c("proto").alias("protocol"),
                       c("service").alias("app"), (c("dur") * 2000).alias("duration"), (c("sbytes") + c("dbytes")).alias("bytes"), (c("spkts") + c("dpkts")).alias("packets"))
    out, report = N.normalize(raw, keep=["row_id"], context=["ct_srv_src", "ct_dst_sport_ltm", "ct_dst_src_ltm"])
    assert report["schema"] == "netflow_or_cloud_flow"
    return out.select(c("raw_row_id").alias("row_id"), "srcip", "dstip", "proto", "service", *r6("dur", "sbytes", "dbytes"), "spkts", "dpkts", F.round("sload", 4).alias("sload"), F.round("dload", 4).alias("dload"),
                      *r6("smeansz", "sintpkt"), "sttl", "state", "ct_srv_src", "ct_dst_sport_ltm", "ct_dst_src_ltm")


@query("normalize_cic", "flows", sql="""
SELECT row_id, round(dur, 6) AS dur, sbytes, round(l_tax * 0.5, 6) AS sintpkt,
  CASE WHEN l_linenumber % 4 = 0 AND l_partkey % 7 = 0 THEN 'RST' WHEN l_partkey % 5 = 0 THEN 'FIN' WHEN l_linenumber % 2 = 1 AND l_partkey % 3 = 0 THEN 'CON' WHEN l_linenumber % 2 = 1 THEN 'SYN' ELSE 'CON' END AS state
FROM flows""")
def normalize_cic(flows: DataFrame) -> DataFrame:
    c = F.col
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    raw = flows.select("row_id", (c("dur") * 1e6).alias("Flow Duration"), c("sbytes").alias("Total Length of Fwd Packets"), c("spkts").alias("Total Fwd Packets"), c("dpkts").alias("Total Backward Packets"),
                       (c("l_tax") * 500000).alias("Fwd IAT Mean"), flag((c("l_linenumber") % 4 == 0) & (c("l_partkey") % 7 == 0)).alias("RST Flag Count"), flag(c("l_partkey") % 5 == 0).alias("FIN Flag Count"),
                       flag(c("l_linenumber") % 2 == 1).alias("SYN Flag Count"), flag(c("l_partkey") % 3 == 0).alias("ACK Flag Count"))
    out, _ = N.normalize(raw, keep=["row_id"])
    return out.select(c("raw_row_id").alias("row_id"), *r6("dur"), "sbytes", *r6("sintpkt"), "state")


@query("production_contract", "flows", sql="""
SELECT row_id AS source_row, strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time, 'cicflowmeter' AS source, srcip AS src_ip, dsport::DOUBLE AS dst_port, trim(proto) AS protocol, round(dur, 6) AS duration,
  label AS dataset_label, CASE WHEN lower(trim(coalesce(attack_raw, ''))) IN ('', 'nan', 'none', 'benign', 'normal', '0') THEN 'Normal' ELSE trim(attack_raw) END AS attack_category,
  CASE WHEN label = '0' THEN 'normal' ELSE 'known_attack' END AS analyst_label, '' AS split
FROM flows""")
def production_contract(flows: DataFrame) -> DataFrame:
    raw = flows.select("row_id", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "srcip", "dstip", "sport", "dsport", "proto", "service", "dur", "sbytes", "dbytes", "spkts", "dpkts", "label", F.col("attack_raw").alias("attack_cat"))
    out, _ = C.to_contract(raw, "row_id")
    assert out.columns == C.COLUMNS
    return out.select("source_row", "event_time", "source", "src_ip", F.col("dst_port").cast("double").alias("dst_port"), "protocol", *r6("duration"), "dataset_label", "attack_category", "analyst_label", "split")


@query("label_overrides", "flows", sql="""
, flat AS (SELECT DISTINCT row_id, CASE WHEN label = '0' THEN 'normal' ELSE 'known_attack' END AS analyst_label, label AS attack_category FROM flows),
patch AS (SELECT row_id, CASE l_suppkey % 3 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'suspicious' ELSE 'normal' END AS al, CASE WHEN l_suppkey % 2 = 0 THEN 'reviewed' END AS ac
  FROM flows WHERE l_partkey % 10 = 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY l_partkey * 1000 + l_suppkey DESC) = 1)
SELECT f.row_id, coalesce(p.al, f.analyst_label) AS analyst_label, coalesce(p.ac, f.attack_category) AS attack_category FROM flat f LEFT JOIN patch p USING (row_id)""")
def label_overrides(flows: DataFrame) -> DataFrame:
    flat = flows.select("row_id", C.analyst_label(F.col("label")).alias("analyst_label"), F.col("label").alias("attack_category")).distinct()
    kind = F.when(F.col("l_suppkey") % 3 == 0, " False-Positive").when(F.col("l_suppkey") % 3 == 1, "suspicious").otherwise("Normal ")
    patch = flows.where("l_partkey % 10 = 0").select("row_id", kind.alias("analyst_label"), F.when(F.col("l_suppkey") % 2 == 0, "reviewed").alias("attack_category"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("at"))
    return C.apply_overrides(flat, patch, "row_id", "at").select("row_id", "analyst_label", "attack_category")


@query("split_by_time", "flows", sql="""
, u AS (SELECT row_id, min(event_ts) AS event_ts FROM flows GROUP BY row_id), r AS (SELECT *, row_number() OVER (ORDER BY event_ts NULLS LAST, row_id) AS rn, count(*) OVER () AS n FROM u)
SELECT split, count(*) AS n, min(row_id) AS lo, max(row_id) AS hi, sum(row_id)::BIGINT AS s FROM (
  SELECT row_id, CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train' WHEN rn <= round_even(n * 0.85, 0) THEN 'validation' ELSE 'test' END AS split FROM r) GROUP BY split""")
def split_by_time(flows: DataFrame) -> DataFrame:
    u = flows.groupBy("row_id").agg(F.min("event_ts").alias("event_ts"))
    return C.split_by_time(u, "event_ts", "row_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.sum("row_id").alias("s"))


@query("production_summary", "flows", sql="""
SELECT 'proto' AS "column", coalesce(proto, '') AS value, count(*) AS n FROM flows GROUP BY ALL UNION ALL SELECT 'service', coalesce(service, ''), count(*) FROM flows GROUP BY ALL
UNION ALL SELECT 'state', coalesce(state, ''), count(*) FROM flows GROUP BY ALL UNION ALL SELECT 'label', coalesce(label, ''), count(*) FROM flows GROUP BY ALL""")
def production_summary(flows: DataFrame) -> DataFrame:
    return C.value_counts(flows, ["proto", "service", "state", "label"])


FAMILY_SQL = """CASE lower(CASE WHEN trim(coalesce(attack_raw, '')) IN ('nan', 'NaN', '', 'None', '-') THEN 'Normal' ELSE trim(attack_raw) END) WHEN 'normal' THEN 'Normal' WHEN 'dos' THEN 'DoS' WHEN 'exploit' THEN 'Exploits'
 WHEN 'reconnaissance' THEN 'Reconnaissance' WHEN 'generic' THEN 'Generic' WHEN 'fuzzer' THEN 'Fuzzers' WHEN 'analysis' THEN 'Analysis' WHEN 'backdoor' THEN 'Backdoors' WHEN 'shellcode' THEN 'Shellcode' WHEN 'worms' THEN 'Worms' END"""


@query("canonical_families", "flows", sql=f"SELECT attack_cat, label_binary, count(*) AS n FROM (SELECT {FAMILY_SQL} AS attack_cat, ({FAMILY_SQL} <> 'Normal')::INT AS label_binary FROM flows) GROUP BY ALL")
def canonical_families(flows: DataFrame) -> DataFrame:
    out = L.with_family(flows, "attack_raw")
    return out.groupBy("attack_cat", "label_binary").agg(F.count(F.lit(1)).alias("n"))


@query("engineered_features", "flows", sql="""
SELECT row_id, l_partkey, l_suppkey, round(sbytes / (sbytes + dbytes + 1e-8), 6) AS bytes_ratio, round(ln(1 + sbytes + dbytes + 1e-8), 6) AS log_total_bytes, round(spkts / (spkts + dpkts + 1e-8), 6) AS pkts_ratio,
  round(sbytes / greatest(dur, 1e-6), 4) AS src_bps, round((spkts + 1e-8) / greatest(dur, 1e-6), 6) AS pkt_rate, abs(sttl - dttl) AS ttl_diff, sttl + dttl AS ttl_sum, round(sloss / (spkts + 1e-8), 6) AS loss_rate_src,
  round(synack / (ackdat + 1e-8), 2) AS handshake_ratio, CASE WHEN synack > 0 AND ackdat = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS incomplete_tcp
FROM flows""")
def engineered_features(flows: DataFrame) -> DataFrame:
    out = L.engineered(flows)
    return out.select("row_id", "l_partkey", "l_suppkey", *r6("bytes_ratio", "log_total_bytes", "pkts_ratio"), F.round("src_bps", 4).alias("src_bps"), *r6("pkt_rate"), "ttl_diff", "ttl_sum", *r6("loss_rate_src"), F.round("handshake_ratio", 2).alias("handshake_ratio"), "incomplete_tcp")


@query("category_codes", "flows", sql="""
, v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT CASE WHEN service IS NULL THEN 'missing:' ELSE 'value:' || lower(trim(service)) END AS token FROM flows WHERE l_linenumber % 4 <> 3)),
t AS (SELECT CASE WHEN service IS NULL THEN 'missing:' ELSE 'value:' || lower(trim(service)) END AS token FROM flows)
SELECT t.token, round(coalesce(v.idx::DOUBLE, -(1 + (('0x' || substr(sha256('["category-v1","service","' || t.token || '"]'), 9, 8))::BIGINT % 8388608 + 1) / 8388608.0)), 9) AS code,
  coalesce(v.idx + 2, 1) AS frozen, count(*) AS n FROM t LEFT JOIN v USING (token) GROUP BY ALL""")
def category_codes(flows: DataFrame) -> DataFrame:
    vocab = L.vocabulary(flows.where("l_linenumber % 4 <> 3"), "service")
    coded = L.encoded(flows.select("service"), "service", vocab).withColumnRenamed("service_num", "code")
    both = L.encoded(coded, "service", vocab, "index").withColumnRenamed("service_num", "frozen")
    return both.select(S.category_token(F.col("service")).alias("token"), F.round("code", 9).alias("code"), F.col("frozen").cast("long").alias("frozen")).groupBy("token", "code", "frozen").agg(F.count(F.lit(1)).alias("n"))


@query("robust_scaling", "flows", sql="""
, q AS (SELECT median(sbytes) AS sc, quantile_cont(sbytes, 0.75) - quantile_cont(sbytes, 0.25) AS si, median(dttl) AS dc, quantile_cont(dttl, 0.75) - quantile_cont(dttl, 0.25) AS di FROM flows WHERE l_orderkey % 5 < 2)
SELECT row_id, l_partkey, l_suppkey, round(least(greatest((sbytes - sc) / CASE WHEN si = 0 THEN 1 ELSE si END, -10), 10), 6) AS sbytes, round(least(greatest((dttl - dc) / CASE WHEN di = 0 THEN 1 ELSE di END, -10), 10), 6) AS dttl FROM flows, q""")
def robust_scaling(flows: DataFrame) -> DataFrame:
    fitted = L.robust_fit(flows.where("l_orderkey % 5 < 2"), ["sbytes", "dttl"])
    return L.robust_apply(flows.select("row_id", "l_partkey", "l_suppkey", "sbytes", "dttl"), fitted, ["sbytes", "dttl"]).select("row_id", "l_partkey", "l_suppkey", *r6("sbytes", "dttl"))


@query("protocol_tokens", "packets", sql="""
SELECT token, CASE WHEN regexp_full_match(token, 'IPPROTO_(0|[1-9][0-9]{0,2})') AND substr(token, 9)::INT <= 255 THEN substr(token, 9)::INT + 2 ELSE 1 END AS code, count(*) AS n
FROM (SELECT CASE WHEN ip_total_length BETWEEN 0 AND 255 THEN 'IPPROTO_' || ip_total_length ELSE 'IPPROTO_OOV' END AS token FROM packets) GROUP BY ALL""")
def protocol_tokens(packets: DataFrame) -> DataFrame:
    out = packets.select(S.protocol_token(F.col("ip_total_length")).alias("token"))
    return out.select("token", S.protocol_code(F.col("token")).alias("code")).groupBy("token", "code").agg(F.count(F.lit(1)).alias("n"))


IDLE = 6 * 3600 * 10**9
SESSION_SQL = f"""
, k AS (SELECT *, least(src_address || ':' || lpad(src_port::VARCHAR, 5, '0'), dst_address || ':' || lpad(dst_port::VARCHAR, 5, '0')) AS ea,
  greatest(src_address || ':' || lpad(src_port::VARCHAR, 5, '0'), dst_address || ':' || lpad(dst_port::VARCHAR, 5, '0')) AS eb FROM packets),
g AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w > {IDLE} THEN 1 ELSE 0 END AS cut FROM k WINDOW w AS (PARTITION BY ip_protocol, ea, eb ORDER BY timestamp_ns, capture_index)),
n AS (SELECT *, sum(cut) OVER (PARTITION BY ip_protocol, ea, eb ORDER BY timestamp_ns, capture_index) AS session FROM g),
s AS (SELECT *, row_number() OVER w AS pos, first_value(src_address) OVER w = src_address AND first_value(src_port) OVER w = src_port AS fwd FROM n WINDOW w AS (PARTITION BY ip_protocol, ea, eb, session ORDER BY timestamp_ns, capture_index))"""
FEATURE_SQL = SESSION_SQL + """,
f AS (SELECT ip_protocol, ea, eb, session, min(timestamp_ns) AS start_ns, arg_min(capture_index, pos) AS first_index, (max(timestamp_ns) - min(timestamp_ns)) / 1e9 AS duration_seconds, count(*) FILTER (WHERE fwd)::DOUBLE AS fp,
  count(*) FILTER (WHERE NOT fwd)::DOUBLE AS bp, coalesce(sum(ip_total_length) FILTER (WHERE fwd), 0)::DOUBLE AS fb, coalesce(sum(ip_total_length) FILTER (WHERE NOT fwd), 0)::DOUBLE AS bb FROM s GROUP BY ALL)"""


@query("flow_features", "packets", sql=FEATURE_SQL + """
SELECT first_index, ip_protocol, start_ns, round(duration_seconds, 6) AS duration_seconds, fp AS forward_packet_count, bp AS backward_packet_count, fb + bb AS total_byte_count, round(fp / (fp + bp), 6) AS forward_packet_fraction,
  CASE WHEN bp > 0 THEN round(bb / bp, 6) END AS backward_mean_packet_size_bytes, CASE WHEN duration_seconds > 0 THEN round((fb + bb) / duration_seconds, 6) END AS bytes_per_second, 'IPPROTO_' || ip_protocol AS protocol_token FROM f""")
def flow_features(packets: DataFrame) -> DataFrame:
    out = P.flow_features(P.sessions(packets, IDLE))
    return out.select("first_index", "ip_protocol", "start_ns", *r6("duration_seconds"), "forward_packet_count", "backward_packet_count", "total_byte_count", *r6("forward_packet_fraction", "backward_mean_packet_size_bytes", "bytes_per_second"), "protocol_token")


@query("flow_numbering", "packets", sql=FEATURE_SQL + "\nSELECT 'flow-' || lpad((row_number() OVER (ORDER BY start_ns, first_index) - 1)::VARCHAR, 12, '0') AS flow_id, first_index FROM f")
def flow_numbering(packets: DataFrame) -> DataFrame:
    return P.numbered_flows(P.flow_features(P.sessions(packets, IDLE))).select("flow_id", "first_index")


@query("flow_transport", "packets", sql=SESSION_SQL + """,
t AS (SELECT *, (timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY ip_protocol, ea, eb, session ORDER BY pos)) / 1e9 AS iat, (timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY ip_protocol, ea, eb, session, fwd ORDER BY pos)) / 1e9 AS siat,
  ip_protocol = 6 AS tcp, coalesce(tcp_flags, 0) AS fl FROM s),
h1 AS (SELECT *, min(CASE WHEN tcp AND fwd AND fl & 2 <> 0 AND fl & 16 = 0 THEN pos END) OVER (PARTITION BY ip_protocol, ea, eb, session ORDER BY pos) AS p1 FROM t),
h2 AS (SELECT *, min(CASE WHEN pos > p1 AND NOT fwd AND fl & 18 = 18 THEN pos END) OVER (PARTITION BY ip_protocol, ea, eb, session ORDER BY pos) AS p2 FROM h1),
h3 AS (SELECT *, min(CASE WHEN pos > p2 AND fwd AND fl & 16 <> 0 AND fl & 2 = 0 THEN pos END) OVER (PARTITION BY ip_protocol, ea, eb, session ORDER BY pos) AS p3 FROM h2),
a AS (SELECT ip_protocol, arg_min(capture_index, pos) AS first_index, avg(iat) AS im, CASE WHEN count(iat) >= 2 THEN stddev_pop(iat) END AS isd, avg(siat) FILTER (WHERE fwd) AS fm, CASE WHEN count(siat) FILTER (WHERE NOT fwd) >= 2 THEN stddev_pop(siat) FILTER (WHERE NOT fwd) END AS bsd,
  count(*) FILTER (WHERE tcp AND fl & 1 <> 0) AS tcp_fin_count, count(*) FILTER (WHERE tcp AND fl & 2 <> 0) AS tcp_syn_count, count(*) FILTER (WHERE tcp AND fl & 8 <> 0) AS tcp_psh_count,
  min(timestamp_ns) FILTER (WHERE pos = p1) AS t1, min(timestamp_ns) FILTER (WHERE pos = p2) AS t2, min(timestamp_ns) FILTER (WHERE pos = p3) AS t3, bool_or(fl & 4 <> 0) AS rst, bool_or(fl & 1 <> 0 AND fwd) AS ff, bool_or(fl & 1 <> 0 AND NOT fwd) AS bf, bool_or(fl & 2 <> 0) AS syn
  FROM h3 GROUP BY ip_protocol, ea, eb, session)
SELECT first_index, round(im, 6) AS flow_iat_mean_seconds, round(isd, 4) AS flow_iat_std_seconds, round(fm, 6) AS forward_iat_mean_seconds, round(bsd, 4) AS backward_iat_std_seconds, tcp_fin_count, tcp_syn_count, tcp_psh_count,
  round((t2 - t1) / 1e9, 6) AS tcp_synack_seconds, round((t2 - t1) / 1e9 + (t3 - t2) / 1e9, 6) AS tcp_handshake_seconds,
  CASE WHEN ip_protocol <> 6 THEN 'NOT_TCP' WHEN rst THEN 'TCP_RESET' WHEN ff AND bf THEN 'TCP_CLOSED' WHEN t3 IS NOT NULL THEN 'TCP_ESTABLISHED' WHEN syn THEN 'TCP_PARTIAL_HANDSHAKE' ELSE 'TCP_OBSERVED' END AS portable_connection_state FROM a""")
def flow_transport(packets: DataFrame) -> DataFrame:
    out = P.transport(P.sessions(packets, IDLE))
    return out.select("first_index", *r6("flow_iat_mean_seconds"), F.round("flow_iat_std_seconds", 4).alias("flow_iat_std_seconds"), *r6("forward_iat_mean_seconds"), F.round("backward_iat_std_seconds", 4).alias("backward_iat_std_seconds"),
                      "tcp_fin_count", "tcp_syn_count", "tcp_psh_count", *r6("tcp_synack_seconds", "tcp_handshake_seconds"), "portable_connection_state")


@query("interval_label_join", "packets", "rules", sql=FEATURE_SQL + """,
o AS (SELECT s.capture_index, s.timestamp_ns AS start_ns, s.ip_protocol, s.src_address, s.dst_address, s.src_port, s.dst_port FROM s WHERE pos = 1),
m AS (SELECT o.capture_index, r.rule_id, r.source_label, r.portable_label FROM o JOIN rules r ON o.start_ns BETWEEN r.start_ns AND r.end_ns AND (r.ip_protocol IS NULL OR r.ip_protocol = o.ip_protocol) AND (r.source_address IS NULL OR r.source_address = o.src_address)
  AND (r.destination_address IS NULL OR r.destination_address = o.dst_address) AND (r.source_port IS NULL OR r.source_port = o.src_port) AND (r.destination_port IS NULL OR r.destination_port = o.dst_port))
SELECT o.capture_index AS first_index, CASE WHEN count(m.rule_id) = 0 THEN 'UNMATCHED' WHEN count(DISTINCT m.source_label || m.portable_label) = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status,
  CASE WHEN count(DISTINCT m.source_label || m.portable_label) = 1 THEN min(m.source_label) END AS source_label, CASE WHEN count(DISTINCT m.source_label || m.portable_label) = 1 THEN min(m.portable_label) END AS portable_label,
  coalesce(string_agg(m.rule_id, ',' ORDER BY m.rule_id), '') AS rule_ids FROM o LEFT JOIN m USING (capture_index) GROUP BY o.capture_index""")
def interval_label_join(packets: DataFrame, rules: DataFrame) -> DataFrame:
    flows = P.flow_features(P.sessions(packets, IDLE))
    return P.join_rules(flows, rules, "first_index").select("first_index", "status", "source_label", "portable_label", joined("rule_ids"))


@query("flow_contract_violations", "packets", sql=FEATURE_SQL + """
SELECT 'negative' AS rule, count(*) FILTER (WHERE first_index % 7 = 0) AS n FROM f UNION ALL SELECT 'fraction_outside', count(*) FILTER (WHERE first_index % 11 = 0) FROM f
UNION ALL SELECT 'rate_without_duration', count(*) FILTER (WHERE duration_seconds = 0 AND first_index % 5 = 0) FROM f""")
def flow_contract_violations(packets: DataFrame) -> DataFrame:
    flows, i = P.flow_features(P.sessions(packets, IDLE)), F.col("first_index")
    # the features of a flow keep the contract by construction: some are broken here
    broken = flows.withColumn("backward_byte_count", F.when(i % 7 == 0, -F.col("backward_byte_count") - 1).otherwise(F.col("backward_byte_count")))
    broken = broken.withColumn("forward_packet_fraction", F.when(i % 11 == 0, F.col("forward_packet_fraction") + 1).otherwise(F.col("forward_packet_fraction")))
    broken = broken.withColumn("packets_per_second", F.when(i % 5 == 0, F.coalesce("packets_per_second", F.lit(1.0))).otherwise(F.col("packets_per_second")))
    return P.violations(broken)


@query("flow_identity_multiplicity", "packets", sql=FEATURE_SQL + """,
i AS (SELECT count(*) AS multiplicity FROM f GROUP BY ip_protocol, round(duration_seconds * 1000000), fp, bp, fb, bb) SELECT multiplicity, count(*) AS identities FROM i GROUP BY 1""")
def flow_identity_multiplicity(packets: DataFrame) -> DataFrame:
    from netloom.operators.identity import multiplicity

    return multiplicity(P.flow_identity(P.flow_features(P.sessions(packets, IDLE))))
