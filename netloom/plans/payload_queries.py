"""Named query on the raw candidates of flows, over packets whose payload stands for what a capture would hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import payloads as P
from netloom.operators.flows import sessions
from netloom.plans.base import Query, adder, r6
from netloom.plans.flow_queries import IDLE, SESSION_SQL

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)

_TEXT = """CASE WHEN capture_index % 6 = 0 THEN 'GET /' || CAST(capture_index AS STRING) || ' HTTP/1.1' || chr(13) || chr(10) WHEN capture_index % 6 = 1 THEN 'HTTP/1.1 200 OK' || chr(13) || chr(10) || chr(13) || chr(10) || CAST(capture_index AS STRING)
  WHEN capture_index % 12 = 2 THEN 'user anonymous' || chr(13) || chr(10) WHEN capture_index % 30 = 8 THEN '230 logged in' WHEN capture_index % 6 = 3 THEN 'HTTP/1.1 304 no body' WHEN capture_index % 6 = 4 THEN NULL ELSE 'GETTER 230' END"""
_MORE = "CAST(64 - capture_index % 5 AS INT) AS ttl, CASE WHEN tcp_flags IS NOT NULL THEN capture_index * 1000 END AS tcp_seq, CASE WHEN tcp_flags IS NOT NULL THEN CAST(capture_index % 4096 AS INT) END AS tcp_window"
_SQL = SESSION_SQL.replace("FROM packets)", f"FROM (SELECT *, {_TEXT.replace('STRING', 'VARCHAR')} AS payload, {_MORE} FROM packets))") + """,
e AS (SELECT *, coalesce(tcp_flags, 0) AS fl, regexp_matches(payload, '^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE)\\s+') AS rq, regexp_matches(payload, '^HTTP/[0-9](\\.[0-9])?\\s+') AS rs, instr(payload, chr(13) || chr(10) || chr(13) || chr(10)) AS head,
  regexp_matches(payload, '(?i)^(USER|PASS|RETR|STOR|LIST|CWD|PWD|TYPE|PORT|PASV|QUIT)\\s') AS fc, regexp_matches(payload, '^230(\\s|-)') AS ok, (timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY ip_protocol, ea, eb, session, fwd ORDER BY pos)) AS gap FROM s),
a AS (SELECT *, min(pos) FILTER (WHERE ip_protocol = 6 AND fwd AND fl & 18 = 2) OVER w AS p1 FROM e WINDOW w AS (PARTITION BY ip_protocol, ea, eb, session ORDER BY pos)),
b AS (SELECT *, min(pos) FILTER (WHERE pos > p1 AND NOT fwd AND fl & 18 = 18) OVER w AS p2 FROM a WINDOW w AS (PARTITION BY ip_protocol, ea, eb, session ORDER BY pos)),
d AS (SELECT *, min(pos) FILTER (WHERE pos > p2 AND fwd AND fl & 18 = 16) OVER w AS p3 FROM b WINDOW w AS (PARTITION BY ip_protocol, ea, eb, session ORDER BY pos)),
f AS (SELECT ip_protocol, arg_min(capture_index, pos) AS first_index, (max(timestamp_ns) - min(timestamp_ns)) / 1e9 AS dur, count(*) FILTER (WHERE fwd) AS spkts, count(*) FILTER (WHERE NOT fwd) AS dpkts, coalesce(sum(ip_total_length) FILTER (WHERE fwd), 0)::BIGINT AS sbytes, coalesce(sum(ip_total_length) FILTER (WHERE NOT fwd), 0)::BIGINT AS dbytes,
  arg_min(ttl, pos) FILTER (WHERE fwd) AS sttl, arg_min(ttl, pos) FILTER (WHERE NOT fwd) AS dttl, arg_min(tcp_window, pos) FILTER (WHERE fwd AND tcp_window IS NOT NULL) AS swin, arg_min(tcp_window, pos) FILTER (WHERE NOT fwd AND tcp_window IS NOT NULL) AS dwin,
  arg_min(tcp_seq, pos) FILTER (WHERE fwd AND tcp_seq IS NOT NULL) AS stcpb, arg_min(tcp_seq, pos) FILTER (WHERE NOT fwd AND tcp_seq IS NOT NULL) AS dtcpb, min(timestamp_ns) FILTER (WHERE pos = p1) AS t1, min(timestamp_ns) FILTER (WHERE pos = p2) AS t2, min(timestamp_ns) FILTER (WHERE pos = p3) AS t3,
  coalesce(sum(gap) FILTER (WHERE fwd)::DOUBLE / count(gap) FILTER (WHERE fwd), 0) / 1e6 AS sinpkt, coalesce(sum(gap) FILTER (WHERE NOT fwd)::DOUBLE / count(gap) FILTER (WHERE NOT fwd), 0) / 1e6 AS dinpkt, CASE WHEN count(gap) FILTER (WHERE NOT fwd) > 1 THEN stddev_pop(gap / 1e6) FILTER (WHERE NOT fwd) ELSE 0 END AS djit,
  count(*) FILTER (WHERE rq) AS methods, count(*) FILTER (WHERE rs) AS responses, coalesce(sum(length(payload) - head - 3) FILTER (WHERE rs AND head > 0), 0)::BIGINT AS body, count(*) FILTER (WHERE fc) AS commands, coalesce(bool_or(ok), false) AS login, arg_min(src_address = dst_address AND src_port = dst_port, pos)::INT AS same
  FROM d GROUP BY ip_protocol, ea, eb, session)
SELECT first_index, CASE ip_protocol WHEN 6 THEN 'tcp' ELSE 'udp' END AS proto, CASE WHEN methods + responses > 0 THEN 'http' WHEN commands > 0 OR login THEN 'ftp' END AS service, round(dur, 6) AS dur, spkts, dpkts, sbytes, dbytes, round(CASE WHEN dur > 0 THEN (spkts + dpkts) / dur END, 6) AS rate, coalesce(sttl, -1) AS sttl, coalesce(dttl, -1) AS dttl,
  round(CASE WHEN dur > 0 THEN 8.0::DOUBLE * sbytes / dur END, 6) AS sload, round(CASE WHEN dur > 0 THEN 8.0::DOUBLE * dbytes / dur END, 6) AS dload, round(sinpkt, 3) AS sinpkt, round(dinpkt, 3) AS dinpkt, round(djit, 1) AS djit, coalesce(swin, -1) AS swin, coalesce(dwin, -1) AS dwin, coalesce(stcpb, -1) AS stcpb, coalesce(dtcpb, -1) AS dtcpb, round((t2 - t1) / 1e9, 6) AS synack, round((t3 - t2) / 1e9, 6) AS ackdat, round((t2 - t1) / 1e9 + (t3 - t2) / 1e9, 6) AS tcprtt,
  round(sbytes / spkts, 6) AS smean, round(CASE WHEN dpkts > 0 THEN dbytes / dpkts END, 6) AS dmean, least(methods, responses) AS trans_depth, body AS response_body_len, CASE WHEN login THEN true END AS is_ftp_login, commands AS ct_ftp_cmd, methods AS ct_flw_http_mthd, same AS is_sm_ips_ports FROM f"""


@query("raw_candidates", "packets", sql=_SQL)
def raw_candidates(packets: DataFrame) -> DataFrame:
    rows = packets.withColumn("payload", F.expr(_TEXT).cast("binary")).selectExpr("*", *_MORE.split(", CASE")[:1], *("CASE" + m for m in _MORE.split(", CASE")[1:]))
    out = P.raw_candidates(sessions(rows, IDLE))
    plain = ["first_index", "proto", "service", "spkts", "dpkts", "sbytes", "dbytes", "trans_depth", "response_body_len", "is_ftp_login", "ct_ftp_cmd", "ct_flw_http_mthd", "is_sm_ips_ports"]
    there = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("sttl", "dttl", "swin", "dwin", "stcpb", "dtcpb")]
    return out.select(*plain, *there, *r6("dur", "rate", "sload", "dload", "synack", "ackdat", "tcprtt", "smean", "dmean"), F.round("sinpkt", 3).alias("sinpkt"), F.round("dinpkt", 3).alias("dinpkt"), F.round("djit", 1).alias("djit"))
