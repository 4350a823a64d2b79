"""Named queries on flow candidates, family support, vector checks and the alert log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import alerts as A
from netloom.operators import candidates as C
from netloom.operators import gates as G
from netloom.operators.flows import sessions
from netloom.plans.base import Query, adder
from netloom.plans.flow_queries import IDLE, SESSION_SQL

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)


@query("flow_candidates", "packets", sql=SESSION_SQL + """,
t AS (SELECT *, (timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY ip_protocol, ea, eb, session, fwd ORDER BY pos)) AS gap, coalesce(tcp_flags, 0) AS fl FROM s)
SELECT arg_min(capture_index, pos) AS first_index, coalesce(sum(gap) FILTER (WHERE fwd)::DOUBLE / count(gap) FILTER (WHERE fwd), 0) / 1e6 AS source_iat_ms, coalesce(sum(gap) FILTER (WHERE NOT fwd)::DOUBLE / count(gap) FILTER (WHERE NOT fwd), 0) / 1e6 AS destination_iat_ms,
  round(CASE WHEN count(gap) FILTER (WHERE fwd) > 1 THEN stddev_pop(gap / 1e6) FILTER (WHERE fwd) ELSE 0 END, 1) AS source_jitter_ms,
  CASE WHEN ip_protocol = 6 THEN CASE WHEN bool_or(fl & 4 <> 0) THEN 'LOCAL_RST' WHEN bool_or(fl & 1 <> 0) THEN 'LOCAL_FIN'
    WHEN bool_or(fl & 18 = 2) AND bool_or(fl & 18 = 18) AND bool_or(fl & 16 <> 0) THEN 'LOCAL_ESTABLISHED' WHEN bool_or(fl & 18 = 2) THEN 'LOCAL_SYN_ONLY' ELSE 'LOCAL_OTHER' END END AS local_state
FROM t GROUP BY ip_protocol, ea, eb, session""")
def flow_candidates(packets: DataFrame) -> DataFrame:
    out = C.flow_candidates(sessions(packets, IDLE))
    return out.select("first_index", "source_iat_ms", "destination_iat_ms", F.round("source_jitter_ms", 1).alias("source_jitter_ms"), "local_state")


@query("family_universe", "families", sql="""
, p AS (SELECT identity, label, count(*) AS n FROM families WHERE role = 'train' GROUP BY ALL), a AS (SELECT identity, count(*) > 1 AS several FROM p GROUP BY identity)
SELECT label, label <> 'Normal' AS is_attack_family, sum(n)::BIGINT AS source_rows, count(*) AS source_identities, coalesce(sum(n) FILTER (WHERE several), 0)::BIGINT AS excluded_rows,
  coalesce(sum(n) FILTER (WHERE NOT several), 0)::BIGINT AS retained_rows, count(*) FILTER (WHERE NOT several) AS retained_identities FROM p JOIN a USING (identity) GROUP BY label""")
def family_universe(families: DataFrame) -> DataFrame:
    return C.family_universe(families.where("role = 'train'"))


VECTORS = """
SELECT CASE WHEN spkts < 5 THEN NULL WHEN dloss = 1 THEN array(sttl, dttl) WHEN sloss = 0 THEN array(sttl, dttl, CAST('NaN' AS DOUBLE)) WHEN service IS NULL THEN array(sttl, NULL, dttl) ELSE array(sttl, dttl, sloss) END AS v FROM {flows}
"""


@query("vector_check", "flows", sql="""
, k AS (SELECT CASE WHEN spkts < 5 THEN 'no features' WHEN dloss = 1 THEN 'expected 3 features, received 2' WHEN sloss = 0 OR service IS NULL THEN 'features are not finite' END AS problem FROM flows)
SELECT problem, count(*) AS n FROM k GROUP BY problem""")
def vector_check(flows: DataFrame) -> DataFrame:
    vectors = flows.sparkSession.sql(VECTORS, flows=flows)
    return C.with_vector_problem(vectors, "v", 3).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("alert_event_log", "alerts", sql="""
, c AS (SELECT CASE WHEN is_zeroday THEN 'X' || alert_id ELSE alert_id END AS alert_id, event_time, CASE WHEN risk >= 70 THEN 'open' ELSE 'closed' END AS status, analyst_note FROM alerts)
SELECT alert_id, event_time AS created_at, 'saved' AS event_type, '{"source":"' || source || '","status":"' || coalesce(status, '') || '","severity":"' || coalesce(llm_severity, '') || '"}' AS payload_json FROM alerts
UNION ALL SELECT alert_id, event_time, 'status_updated', '{"status":"' || status || '","analyst_note":"' || analyst_note || '"}' FROM c WHERE alert_id IN (SELECT alert_id FROM alerts)""")
def alert_event_log(alerts: DataFrame) -> DataFrame:
    store = alerts.withColumn("updated_at", F.col("event_time"))
    named = F.when(F.col("is_zeroday"), F.concat(F.lit("X"), "alert_id")).otherwise(F.col("alert_id"))
    changes = alerts.select(named.alias("alert_id"), F.when(F.col("risk") >= 70, "open").otherwise("closed").alias("status"), F.col("analyst_note").alias("note"), F.col("event_time").alias("at"))
    return A.saved_events(store).unionByName(A.status_events(store, changes))


@query("clean_rows", "flows", sql="""
, d AS (SELECT DISTINCT srcip, dstip, proto, CASE WHEN sloss <> 0 THEN dttl END AS load FROM flows)
SELECT srcip, count(*) AS n, count(load) AS finite FROM d GROUP BY srcip""")
def clean_rows(flows: DataFrame) -> DataFrame:
    load = F.when(F.col("sloss") == 0, float("inf")).otherwise(F.col("dttl")).alias("load")
    return G.clean(flows.select("srcip", "dstip", "proto", load)).groupBy("srcip").agg(F.count(F.lit(1)).alias("n"), F.count("load").alias("finite"))


@query("capture_scope", "packets", sql="""
SELECT ip_protocol, count(*) AS n FROM packets WHERE NOT ((src_address = '10.0.0.8' AND dst_address = '10.1.0.1') OR (src_address = '10.1.0.1' AND dst_address = '10.0.0.8')) GROUP BY ip_protocol""")
def capture_scope(packets: DataFrame) -> DataFrame:
    return G.outside_scope(packets, "10.1.0.1", "10.0.0.8").groupBy("ip_protocol").agg(F.count(F.lit(1)).alias("n"))
