"""Flow, score, packet, rule and alert frames over the driver's tables, in SQL that Spark and DuckDB both take.

The driver has no capture files, so the tables' columns stand for the fields of flows: the same text defines a frame
for the engine and for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOWS = """
SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey, l_suppkey, l_linenumber,
  '10.0.' || CAST(l_suppkey % 20 AS STRING) || '.' || CAST(l_partkey % 8 AS STRING) AS srcip,
  '192.168.' || CAST(l_partkey % 16 AS STRING) || '.' || CAST(l_linenumber AS STRING) AS dstip,
  1024 + l_partkey % 50 AS sport, CASE l_linenumber % 4 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 22 END AS dsport,
  CASE l_linenumber % 3 WHEN 0 THEN 'udp' WHEN 1 THEN 'tcp' ELSE 'TCP ' END AS proto,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_linenumber % 4 = 0 THEN 'dns' WHEN l_linenumber % 4 = 3 THEN 'ssh' ELSE 'http' END AS service,
  l_linestatus || l_returnflag AS state, l_quantity / 10 AS dur, l_extendedprice AS sbytes, l_extendedprice * l_discount AS dbytes,
  l_quantity AS spkts, CAST(l_linenumber AS DOUBLE) AS dpkts, CAST(32 * (1 + l_linenumber % 4) AS DOUBLE) AS sttl, CAST(64 AS DOUBLE) AS dttl,
  CAST(l_suppkey % 3 AS DOUBLE) AS sloss, CAST(l_partkey % 2 AS DOUBLE) AS dloss, l_tax AS synack, l_discount AS ackdat,
  CASE (l_suppkey + l_linenumber) % 13 WHEN 0 THEN ' normal' WHEN 1 THEN 'DoS' WHEN 2 THEN 'Exploit' WHEN 3 THEN 'reconnaissance ' WHEN 4 THEN 'Generic'
    WHEN 5 THEN 'fuzzer' WHEN 6 THEN 'Analysis' WHEN 7 THEN 'backdoor' WHEN 8 THEN 'Shellcode' WHEN 9 THEN 'worms' WHEN 10 THEN '-' ELSE NULL END AS attack_raw,
  CASE WHEN (l_suppkey + l_linenumber) % 13 IN (0, 10, 11, 12) THEN '0' ELSE 'attack' END AS label,
  CAST(l_shipdate AS TIMESTAMP) AS event_ts, l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey
FROM {lineitem}
"""
FAMILIES = """
SELECT row_id, CASE (l_suppkey + l_linenumber) % 13 WHEN 1 THEN 'DoS' WHEN 2 THEN 'Exploits' WHEN 3 THEN 'Reconnaissance' WHEN 4 THEN 'Generic' WHEN 5 THEN 'Fuzzers'
    WHEN 6 THEN 'Analysis' WHEN 7 THEN 'Backdoors' WHEN 8 THEN 'Shellcode' WHEN 9 THEN 'Worms' ELSE 'Normal' END AS label,
  'id' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS identity,
  CASE l_orderkey % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'train' WHEN 2 THEN 'val' WHEN 3 THEN 'meta_known' ELSE 'calibration' END AS role,
  'v' || CAST(l_partkey % 97 AS STRING) AS coarse, l_quantity, l_extendedprice, l_orderkey
FROM ({flows}) f
"""
SCORES = """
SELECT row_id AS source_row, l_discount * 10 AS ae_score, 1 - l_tax * 6 AS max_prob, l_discount * 5 + l_tax * 3 AS hybrid_score, l_quantity / 50 AS softmax,
  CASE (l_suppkey + 2 * l_linenumber) % 5 WHEN 0 THEN 'DoS' WHEN 1 THEN 'Exploits' WHEN 2 THEN 'Generic' ELSE 'Normal' END AS classifier_class, label, attack_raw,
  l_partkey % 1000 AS identity, l_suppkey % 3 AS seed, event_ts, srcip, dstip, coalesce(service, '') AS service
FROM ({flows}) f
"""
PACKETS = """
SELECT event_id AS capture_index, {epoch_us}(CAST(ts AS TIMESTAMP)) * 1000 AS timestamp_ns,
  CASE WHEN event_id % 3 = 0 THEN '10.1.0.' || CAST(user_id % 7 AS STRING) ELSE '10.0.0.' || CAST(user_id AS STRING) END AS src_address,
  CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || CAST(user_id AS STRING) ELSE '10.1.0.' || CAST(user_id % 7 AS STRING) END AS dst_address,
  CASE WHEN user_id % 4 = 0 THEN 17 ELSE 6 END AS ip_protocol, CASE WHEN event_id % 3 = 0 THEN 443 ELSE 1000 + user_id END AS src_port,
  CASE WHEN event_id % 3 = 0 THEN 1000 + user_id ELSE 443 END AS dst_port, 40 + event_id % 1400 AS ip_total_length,
  CASE WHEN user_id % 4 = 0 THEN NULL WHEN event_id % 3 = 0 THEN (CASE event_id % 4 WHEN 0 THEN 18 WHEN 1 THEN 16 WHEN 2 THEN 24 ELSE 17 END)
    ELSE (CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 16 WHEN 2 THEN 24 WHEN 3 THEN 17 ELSE 16 END) END AS tcp_flags
FROM {events}
"""
ALERTS = """
SELECT 'ZD-' || lpad(CAST(event_id AS STRING), 8, '0') AS alert_id, CAST(ts AS TIMESTAMP) AS event_time, '2024-01-' || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') AS timestamp,
  CASE WHEN user_id % 9 = 0 THEN ' - ' ELSE '10.0.0.' || CAST(user_id % 40 AS STRING) END AS src_ip, '10.1.0.' || CAST(event_id % 5 AS STRING) AS dst_ip, event_type AS service,
  CASE event_id % 6 WHEN 0 THEN 'DoS' WHEN 1 THEN 'Exploits' WHEN 2 THEN 'Generic' ELSE 'Normal' END AS classifier_class, CASE WHEN event_id % 10 = 0 THEN 'Worms' ELSE '' END AS zero_day_family,
  event_id % 4 = 0 AS is_zeroday, CAST(event_id % 101 AS INT) AS risk, CASE event_id % 7 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE NULL END AS llm_severity,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'closed' ELSE 'new' END AS status, 'batch' AS source, 'Known-Attack' AS predicted_class, event_type || ' seen' AS analyst_note, user_id, event_id, value
FROM {events}
"""
RULES = """
SELECT 'r' || CAST(c_custkey AS STRING) AS rule_id, CAST(1704067200000000000 AS BIGINT) + CAST(c_custkey % 30 AS BIGINT) * 86400000000000 AS start_ns,
  CAST(1704067200000000000 AS BIGINT) + CAST(c_custkey % 30 AS BIGINT) * 86400000000000 + 21600000000000 AS end_ns,
  'kind' || CAST(c_custkey % 3 AS STRING) AS source_label, CASE WHEN c_custkey % 2 = 0 THEN 'NORMAL' ELSE 'ATTACK' END AS portable_label,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CASE WHEN c_custkey % 4 = 0 THEN 17 ELSE 6 END END AS ip_protocol, '10.0.0.' || CAST(c_custkey % 60 AS STRING) AS source_address,
  CAST(NULL AS STRING) AS destination_address, CAST(NULL AS BIGINT) AS source_port, CASE WHEN c_custkey % 3 = 0 THEN 443 ELSE NULL END AS destination_port
FROM {customer}
"""
FRAMES = {"flows": FLOWS, "families": FAMILIES, "scores": SCORES, "packets": PACKETS, "alerts": ALERTS, "rules": RULES}
TABLES = ("lineitem", "events", "customer")


def text(name: str, tables: dict[str, str], epoch_us: str) -> str:
    inner = FLOWS.format(**tables) if "{flows}" in FRAMES[name] else ""
    return FRAMES[name].format(**tables, epoch_us=epoch_us, flows=inner)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(text(name, {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}, "unix_micros"))


def with_frames(sql: str, *names: str) -> str:
    """A DuckDB query with the frames in front."""
    parts = [f"{n} AS ({text(n, {t: t for t in TABLES}, 'epoch_us')})" for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts) + ("," if sql.lstrip().startswith(",") else "") + "\n" + sql.lstrip().lstrip(",")
