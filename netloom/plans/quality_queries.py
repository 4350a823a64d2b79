"""Named queries on scores, thresholds, metrics, drift, alerts and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators import alerts as A
from netloom.operators import metrics as M
from netloom.plans.base import Query, adder, joined, r6

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)

VOTE = {"decision_mode": "vote", "min_votes": 2, "hybrid": 0.35, "ae_re": 0.55, "softmax": 0.25}


def decided(scores: DataFrame) -> DataFrame:
    c = F.col
    flag, _ = S.anomaly_decision(c("ae_score"), c("max_prob"), c("hybrid_score"), VOTE)
    out = scores.withColumn("is_zeroday", flag)
    return out.withColumn("predicted_class", S.verdict(c("is_zeroday"), c("classifier_class")))


DECIDED = """
, dec AS (SELECT *, ((hybrid_score > 0.35)::INT + (ae_score > 0.55)::INT + (1 - max_prob > 0.25)::INT) >= 2 AS is_zeroday FROM scores),
v AS (SELECT *, CASE WHEN is_zeroday THEN 'Zero-Day Candidate' WHEN classifier_class = 'Normal' THEN 'Normal' ELSE 'Known-Attack' END AS predicted_class, label <> '0' AS attack FROM dec)"""
RISK = "least(100, round_even(25 + 45 * hybrid_score + 15 * least(ae_score, 1) + CASE WHEN is_zeroday THEN 15 ELSE 0 END, 0))::INT"


@query("score_decisions", "scores", sql=DECIDED + f" SELECT predicted_class, is_zeroday, count(*) AS n, sum({RISK})::BIGINT AS risk FROM v GROUP BY ALL")
def score_decisions(scores: DataFrame) -> DataFrame:
    c = F.col
    risk = S.risk_score(c("hybrid_score"), c("ae_score"), c("is_zeroday"), F.lit("high"))
    return decided(scores).groupBy("predicted_class", "is_zeroday").agg(F.count(F.lit(1)).alias("n"), F.sum(risk).alias("risk"))


@query("score_summary", "scores", sql=DECIDED + """
SELECT count(*) AS rows, count(*) FILTER (WHERE is_zeroday) AS zero_day_count, round(avg(is_zeroday::INT), 6) AS zero_day_rate, count(*) FILTER (WHERE NOT attack) AS normal_count, round(avg(is_zeroday::INT) FILTER (WHERE NOT attack), 6) AS normal_ood_fpr,
  round(avg((is_zeroday OR classifier_class <> 'Normal')::INT) FILTER (WHERE NOT attack), 6) AS normal_alert_fpr, round(avg((classifier_class <> 'Normal')::INT) FILTER (WHERE NOT attack), 6) AS known_classifier_fpr,
  round(avg((is_zeroday AND classifier_class <> 'Normal')::INT) FILTER (WHERE NOT attack), 6) AS normal_overlap_rate, count(*) FILTER (WHERE attack) AS attack_count, round(avg((predicted_class <> 'Normal')::INT) FILTER (WHERE attack), 6) AS attack_detection_rate,
  round(avg(((predicted_class <> 'Normal') = attack)::INT), 6) AS detection_accuracy, 0::BIGINT AS inconsistent_rows FROM v""")
def score_summary(scores: DataFrame) -> DataFrame:
    return M.score_summary(decided(scores))


@query("score_distribution", "scores", sql="""
, l AS (UNPIVOT (SELECT ae_score, max_prob, hybrid_score, softmax FROM scores) ON ae_score, max_prob, hybrid_score, softmax INTO NAME name VALUE x)
SELECT name, count(*) AS n, round(min(x), 6) AS min, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, round(max(x), 6) AS max, round(avg(x), 6) AS mean FROM l GROUP BY name""")
def score_distribution(scores: DataFrame) -> DataFrame:
    return M.distribution(scores, ["ae_score", "max_prob", "hybrid_score", "softmax"]).select("name", "n", *r6("min", "p50", "p90", "p95", "p99", "max", "mean"))


@query("calibrated_thresholds", "scores", sql="""
, l AS (UNPIVOT (SELECT ae_score, hybrid_score, softmax FROM scores WHERE label = '0') ON ae_score, hybrid_score, softmax INTO NAME name VALUE x) SELECT name, round(quantile_cont(x, 0.99), 6) AS threshold, count(*) AS n FROM l GROUP BY name""")
def calibrated_thresholds(scores: DataFrame) -> DataFrame:
    out = M.calibrated(scores, ["ae_score", "hybrid_score", "softmax"], S.truth_verdict(F.col("label")) == "Normal")
    return out.select("name", *r6("threshold"), "n")


@query("upper_quantile_threshold", "scores", sql=", r AS (SELECT hybrid_score AS x, row_number() OVER (ORDER BY hybrid_score) AS i, count(*) OVER () AS n FROM scores) SELECT round(min(x), 6) AS threshold FROM r WHERE i >= ceil((n - 1) * 0.99) + 1")
def upper_quantile_threshold(scores: DataFrame) -> DataFrame:
    return M.upper_quantile(scores, "hybrid_score").select(*r6("threshold"))


@query("identity_means", "scores", sql="SELECT identity, seed, round(avg(ae_score), 6) AS ae_score, count(*) AS rows FROM scores GROUP BY ALL")
def identity_means(scores: DataFrame) -> DataFrame:
    return M.identity_means(scores, ["identity", "seed"], "ae_score").select("identity", "seed", *r6("ae_score"), "rows")


RANKING = """
, x AS (SELECT seed, round(hybrid_score, 6) AS h, count(*) FILTER (WHERE label <> '0') AS p, count(*) FILTER (WHERE label = '0') AS n FROM scores GROUP BY ALL),
r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM x WINDOW w AS (PARTITION BY seed ORDER BY h DESC))"""


@query("ranking_quality", "scores", sql=RANKING + " SELECT seed, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(sum(n * (tp - p) + n * p / 2.0) / (sum(p) * sum(n)), 6) AS auroc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM r GROUP BY seed")
def ranking_quality(scores: DataFrame) -> DataFrame:
    rounded = scores.withColumn("h", F.round("hybrid_score", 6))
    return M.ranking(rounded, "h", F.col("label") != "0", ["seed"]).select("seed", "positives", "negatives", *r6("auroc", "average_precision"))


@query("alert_rates", "scores", sql="""
, t AS (SELECT seed, count(*) FILTER (WHERE label <> '0' AND h) AS tp, count(*) FILTER (WHERE label = '0' AND h) AS fp, count(*) FILTER (WHERE label = '0' AND NOT h) AS tn, count(*) FILTER (WHERE label <> '0' AND NOT h) AS fn FROM (SELECT *, hybrid_score > 0.305 AS h FROM scores) GROUP BY seed)
SELECT seed, tp, fp, tn, fn, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(1 - fp / (fp + tn), 6) AS specificity, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round((tp / (tp + fn) + 1 - fp / (fp + tn)) / 2, 6) AS balanced_accuracy FROM t""")
def alert_rates(scores: DataFrame) -> DataFrame:
    out = M.alert_rates(scores, "hybrid_score", F.col("label") != "0", 0.305, ["seed"])
    return out.select("seed", "tp", "fp", "tn", "fn", *r6("tpr", "fpr", "precision", "specificity", "f1", "balanced_accuracy"))


@query("roc_operating_point", "scores", sql="""
, x AS (SELECT round(hybrid_score, 6) AS h, count(*) FILTER (WHERE label <> '0') AS p, count(*) FILTER (WHERE label = '0') AS n FROM scores GROUP BY 1), r AS (SELECT h, sum(p) OVER w / sum(p) OVER () AS tpr, sum(n) OVER w / sum(n) OVER () AS fpr FROM x WINDOW w AS (ORDER BY h DESC))
SELECT h AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r WHERE fpr <= 0.05 ORDER BY r.tpr DESC, r.fpr DESC, h DESC LIMIT 1""")
def roc_operating_point(scores: DataFrame) -> DataFrame:
    out = M.operating_point(scores.withColumn("h", F.round("hybrid_score", 6)), "h", F.col("label") != "0", 0.05)
    return out.select("threshold", *r6("tpr", "fpr"))


@query("top_confusions", "scores", sql="""
, c AS (SELECT service AS truth, classifier_class AS predicted, count(*) AS n FROM scores GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY truth) AS share FROM c) SELECT truth, predicted, n, round(share, 6) AS share FROM s WHERE truth <> predicted ORDER BY n DESC, s.share DESC, truth, predicted LIMIT 10""")
def top_confusions(scores: DataFrame) -> DataFrame:
    return M.confusions(scores.select(F.col("service").alias("truth"), F.col("classifier_class").alias("predicted")), "truth", "predicted").select("truth", "predicted", "n", *r6("share"))


@query("class_report", "scores", sql="""
, t AS (SELECT CASE WHEN label = '0' THEN 'Normal' ELSE 'DoS' END AS truth, classifier_class AS predicted FROM scores), k AS (SELECT truth AS label FROM t UNION SELECT predicted FROM t),
x AS (SELECT label, (SELECT count(*) FROM t WHERE truth = label) AS support, (SELECT count(*) FROM t WHERE predicted = label) AS g, (SELECT count(*) FROM t WHERE truth = label AND predicted = label) AS h FROM k),
y AS (SELECT label, support, CASE WHEN g > 0 THEN h / g ELSE 0 END AS p, CASE WHEN support > 0 THEN h / support ELSE 0 END AS r FROM x)
SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM y""")
def class_report(scores: DataFrame) -> DataFrame:
    t = scores.select(F.when(F.col("label") == "0", "Normal").otherwise("DoS").alias("truth"), F.col("classifier_class").alias("predicted"))
    return M.class_report(t, "truth", "predicted").select("label", "support", *r6("precision", "recall", "f1"))


@query("feature_sanity", "flows", sql="""
, l AS (UNPIVOT (SELECT sbytes, dbytes, spkts, dttl, dpkts FROM flows) ON sbytes, dbytes, spkts, dttl, dpkts INTO NAME name VALUE x), t AS (SELECT name, x, count(*) AS c FROM l GROUP BY ALL), m AS (SELECT name, max(c) AS top, count(*) AS d FROM t GROUP BY name)
SELECT name, count(x) AS n, 0::BIGINT AS missing, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max, any_value(d) <= 1 AS constant, any_value(top) >= 0.99 * count(x) AS near_constant
FROM l JOIN m USING (name) GROUP BY name""")
def feature_sanity(flows: DataFrame) -> DataFrame:
    return M.feature_summary(flows, ["sbytes", "dbytes", "spkts", "dttl", "dpkts"]).select("name", "n", "missing", *r6("min", "q1", "q2", "q3", "max"), "constant", "near_constant")


@query("score_drift", "scores", sql="""
, l AS (UNPIVOT (SELECT seed, ae_score, hybrid_score FROM scores) ON ae_score, hybrid_score INTO NAME name VALUE x),
d AS (SELECT seed, name, avg(x) AS mean, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM l GROUP BY ALL), u AS (UNPIVOT d ON mean, p50, p90, p95, p99 INTO NAME stat VALUE v)
SELECT a.name, a.stat, round(a.v, 6) AS reference, round(b.v, 6) AS current, round(b.v - a.v, 6) AS delta, CASE WHEN abs(a.v) >= 1e-12 THEN round(b.v / a.v, 6) END AS ratio, a.stat = 'p95' AND b.v / a.v > 1.5 AS warn FROM u a JOIN u b ON a.name = b.name AND a.stat = b.stat AND a.seed = 0 AND b.seed = 1""")
def score_drift(scores: DataFrame) -> DataFrame:
    names = ["ae_score", "hybrid_score"]
    out = M.drift(M.distribution(scores.where("seed = 0"), names), M.distribution(scores.where("seed = 1"), names))
    return out.select("name", "stat", *r6("reference", "current", "delta", "ratio"), "warn")


@query("extractor_comparison", "scores", sql="""
, e AS (SELECT ae_score AS a, hybrid_score * 2 AS b, abs(ae_score - hybrid_score * 2) AS e FROM scores)
SELECT 'ae_score' AS name, count(*) AS n, count(*) FILTER (WHERE e <= 0.25) AS within, 0::BIGINT AS null_mismatch, count(*) FILTER (WHERE sign(a) <> sign(b)) AS sign_mismatch, round(avg(e), 6) AS mean_error, round(max(e), 6) AS max_error, round(quantile_cont(e, 0.95), 6) AS p95_error FROM e""")
def extractor_comparison(scores: DataFrame) -> DataFrame:
    out = M.compare_columns(scores.withColumn("b", F.col("hybrid_score") * 2), [("ae_score", "b")], 0.25)
    return out.select("name", "n", "within", "null_mismatch", "sign_mismatch", *r6("mean_error", "max_error", "p95_error"))


@query("adaptive_threshold", "alerts", sql="""
SELECT event_id, round(coalesce(quantile_cont(value, 0.95) OVER w, 1e308), 6) AS threshold, coalesce(value > quantile_cont(value, 0.95) OVER w, false) AS alert FROM alerts WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""")
def adaptive_threshold(alerts: DataFrame) -> DataFrame:
    out = M.adaptive_threshold(alerts.select("event_id", "user_id", "value"), "event_id", "value", "user_id", 50, 0.05)
    return out.select("event_id", F.round(F.least("threshold", F.lit(1e308)), 6).alias("threshold"), "alert")


@query("seed_summary", "scores", sql="""
, c AS (SELECT seed, avg(ae_score) AS ae, avg(hybrid_score) AS hy FROM scores GROUP BY seed), l AS (UNPIVOT c ON ae, hy INTO NAME name VALUE x) SELECT name, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sample_sd, round(min(x), 6) AS min, round(max(x), 6) AS max FROM l GROUP BY name""")
def seed_summary(scores: DataFrame) -> DataFrame:
    cells = scores.groupBy("seed").agg(F.avg("ae_score").alias("ae"), F.avg("hybrid_score").alias("hy"))
    return M.across_seeds(cells, [], ["ae", "hy"]).select("name", *r6("mean", "sample_sd", "min", "max"))


@query("auroc_bootstrap", "scores", sql="""
, m AS (SELECT identity, label <> '0' AS pos, round(avg(hybrid_score), 6) AS s FROM scores GROUP BY ALL),
k AS (SELECT pos, s, row_number() OVER (PARTITION BY pos ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY pos) AS n FROM m), z AS (SELECT pos, any_value(n) AS n FROM k GROUP BY pos),
j AS (SELECT pos, n, r, unnest(range(n)) AS j FROM z, range(1, 201) a(r)), d AS (SELECT r, pos, floor(('0x' || substr(md5('7|' || CASE WHEN pos THEN 'p' ELSE 'n' END || '|' || r || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * n)::BIGINT AS i FROM j),
c AS (SELECT r, s, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM d JOIN k USING (pos, i) GROUP BY ALL), t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM c WINDOW w AS (PARTITION BY r ORDER BY s DESC)),
e AS (SELECT r, sum(n * (tp - p) + n * p / 2.0) / (sum(p) * sum(n)) AS auroc, sum(p * tp / (tp + fp)) / sum(p) AS average_precision, coalesce(sum(p) FILTER (WHERE s > 0.375), 0) / sum(p) AS tpr, coalesce(sum(n) FILTER (WHERE s > 0.375), 0) / sum(n) AS fpr FROM t GROUP BY r),
l AS (UNPIVOT e ON auroc, average_precision, tpr, fpr INTO NAME name VALUE x)
SELECT name, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi, count(*) AS valid, 0::BIGINT AS discarded FROM l GROUP BY name""")
def auroc_bootstrap(scores: DataFrame) -> DataFrame:
    means = scores.groupBy("identity", (F.col("label") != "0").alias("pos")).agg(F.round(F.avg("hybrid_score"), 6).alias("s"))
    return M.bootstrap(means, "s", F.col("pos"), replicates=200, threshold=0.375).select("name", *r6("lo", "hi"), "valid", "discarded")


@query("top_batch_alerts", "scores", sql=DECIDED + """
SELECT 'BATCH-deadbeef-' || lpad(source_row::VARCHAR, greatest(6, length(source_row::VARCHAR))::INT, '0') AS alert_id, is_zeroday, round(hybrid_score, 6) AS hybrid_score FROM v ORDER BY is_zeroday DESC, v.hybrid_score DESC, ae_score DESC, max_prob, source_row LIMIT 25""")
def top_batch_alerts(scores: DataFrame) -> DataFrame:
    return A.top_alerts(decided(scores), "deadbeefcafe").select("alert_id", "is_zeroday", *r6("hybrid_score"))


@query("filtered_alerts", "alerts", sql="SELECT alert_id FROM alerts WHERE coalesce(status, 'new') = 'new' AND upper(coalesce(llm_severity, 'N/A')) = 'HIGH' AND is_zeroday AND contains(lower(alert_id || ' ' || analyst_note), 'click')")
def filtered_alerts(alerts: DataFrame) -> DataFrame:
    return A.filtered(alerts, "new", "high", "OOD only", " Click ").select("alert_id")


KEYED = """
, k AS (SELECT *, unnest(['Source IP', 'Destination IP', 'Service', 'Classifier Class', 'Anomaly Family']) AS group_type, trim(unnest([src_ip, dst_ip, service, classifier_class, zero_day_family])) AS key FROM alerts),
kk AS (SELECT * FROM k WHERE lower(key) NOT IN ('', 'normal', 'nan', 'none', 'null', '-', 'unknown'))"""


@query("correlated_alerts", "alerts", sql=KEYED + """,
n AS (SELECT group_type, key, alert_id, row_number() OVER (PARTITION BY group_type, key ORDER BY alert_id) AS i FROM kk)
SELECT group_type, key, count(*) AS alert_count, count(*) FILTER (WHERE is_zeroday) AS ood_count, max(risk)::DOUBLE AS max_risk, max(timestamp) AS latest_time, (SELECT string_agg(alert_id, ',' ORDER BY alert_id) FROM n WHERE n.group_type = kk.group_type AND n.key = kk.key AND i <= 10) AS alert_ids
FROM kk GROUP BY group_type, key HAVING count(*) >= 2""")
def correlated_alerts(alerts: DataFrame) -> DataFrame:
    out = A.correlated(alerts)
    return out.select("group_type", "key", "alert_count", "ood_count", "max_risk", "latest_time", joined("alert_ids"))


INCIDENT_SQL = KEYED + """,
e AS (SELECT *, epoch_us(event_time) AS t, row_number() OVER (PARTITION BY group_type, key ORDER BY event_time, alert_id) AS i FROM kk),
walk AS (SELECT group_type, key, i, t, t AS anchor FROM e WHERE i = 1
  UNION ALL SELECT e.group_type, e.key, e.i, e.t, CASE WHEN e.t - w.anchor > 900000000 THEN e.t ELSE w.anchor END FROM walk w JOIN e ON e.group_type = w.group_type AND e.key = w.key AND e.i = w.i + 1),
m AS (SELECT e.*, w.anchor FROM e JOIN walk w USING (group_type, key, i)),
g AS (SELECT group_type, key, anchor, max(t) AS z, count(*) AS alert_count, count(*) FILTER (WHERE is_zeroday) AS ood_count, count(*) FILTER (WHERE risk >= 70) AS high_count, max(risk) AS max_risk, max(CASE llm_severity WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END) AS sr,
  string_agg(alert_id, ',' ORDER BY t, alert_id) AS ids FROM m GROUP BY ALL HAVING count(*) >= 2),
tv AS (SELECT group_type, key, anchor, unnest(['primary_classes', 'families', 'source_ips', 'services']) AS name, trim(unnest([classifier_class, zero_day_family, src_ip, service])) AS v FROM m),
tc AS (SELECT group_type, key, anchor, name, v, count(*) AS c FROM tv WHERE lower(v) NOT IN ('', 'normal', 'nan', 'none', 'null', '-', 'unknown') GROUP BY ALL),
ti AS (SELECT *, row_number() OVER (PARTITION BY group_type, key, anchor, name ORDER BY c DESC, v) AS i FROM tc),
tops AS (SELECT group_type, key, anchor, string_agg(v, ',' ORDER BY i) FILTER (WHERE name = 'primary_classes') AS primary_classes, string_agg(v, ',' ORDER BY i) FILTER (WHERE name = 'families') AS families,
  string_agg(v, ',' ORDER BY i) FILTER (WHERE name = 'source_ips') AS source_ips, string_agg(v, ',' ORDER BY i) FILTER (WHERE name = 'services') AS services FROM ti WHERE i <= 3 GROUP BY ALL)
SELECT 'INC-' || upper(substr(sha1(group_type || '|' || key || '|' || strftime(make_timestamp(anchor), '%Y-%m-%dT%H:%M:%S.%f') || '|' || strftime(make_timestamp(z), '%Y-%m-%dT%H:%M:%S.%f')), 1, 10)) AS incident_id, group_type, key, strftime(make_timestamp(anchor), '%Y-%m-%d %H:%M:%S') AS start_time,
  strftime(make_timestamp(z), '%Y-%m-%d %H:%M:%S') AS end_time, alert_count, ood_count, high_count, max_risk, CASE WHEN sr = 3 THEN 'HIGH' WHEN sr = 1 THEN 'LOW' WHEN max_risk >= 85 THEN 'CRITICAL' WHEN max_risk >= 70 THEN 'HIGH' WHEN max_risk >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  15 AS window_minutes, round((z - anchor) / 60e6, 1) AS duration_minutes, primary_classes, families, source_ips, services, array_to_string(string_split(ids, ',')[1:12], ',') AS alert_ids FROM g LEFT JOIN tops USING (group_type, key, anchor)"""


@query("incidents_time_window", "alerts", sql=INCIDENT_SQL)
def incidents_time_window(alerts: DataFrame) -> DataFrame:
    out = A.incidents(alerts)
    return out.select("incident_id", "group_type", "key", "start_time", "end_time", "alert_count", "ood_count", "high_count", "max_risk", "severity", "window_minutes", "duration_minutes", *map(joined, ("primary_classes", "families", "source_ips", "services", "alert_ids")))


@query("alert_upsert", "alerts", sql="""
, s AS (SELECT 'A' || (event_id % 500) AS alert_id, event_id AS seen, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'closed' END AS status, risk FROM alerts)
SELECT alert_id, min(seen) AS created_at, arg_max(status, seen) AS status, arg_max(risk, seen) AS risk, max(seen) AS updated_at FROM s GROUP BY alert_id""")
def alert_upsert(alerts: DataFrame) -> DataFrame:
    status = F.when(F.col("event_id") % 2 == 0, "new").otherwise("closed")
    rows = alerts.select(F.concat(F.lit("A"), (F.col("event_id") % 500).cast("string")).alias("alert_id"), F.col("event_id").alias("created_at"), F.col("event_id").alias("updated_at"), status.alias("status"), "risk")
    return A.merged(rows.where("created_at % 2 = 0"), rows.where("created_at % 2 = 1"), "updated_at").select("alert_id", "created_at", "status", "risk", "updated_at")


@query("alert_listing", "alerts", sql="SELECT alert_id, status FROM alerts WHERE status = 'closed' ORDER BY event_time DESC, alert_id LIMIT 200")
def alert_listing(alerts: DataFrame) -> DataFrame:
    return A.listed(alerts.withColumn("updated_at", F.col("event_time")), 200, "closed").select("alert_id", "status")


@query("queue_summary", "alerts", sql="SELECT count(*) AS alerts, count(*) FILTER (WHERE llm_severity IN ('CRITICAL', 'HIGH')) AS critical_high, count(*) FILTER (WHERE is_zeroday) AS ood, floor(avg(risk))::BIGINT AS mean_risk FROM alerts")
def queue_summary(alerts: DataFrame) -> DataFrame:
    return A.queue_summary(alerts)
