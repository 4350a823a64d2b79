"""Named queries on the figures that reports add: totals, moments, ranges, audits with examples, ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import alerts as A
from netloom.operators import reports as R
from netloom.plans.base import Query, adder, joined, r6

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)

_KNOWN = "('Normal', 'Generic', 'Exploits', 'DoS', 'Reconnaissance')"


@query("report_totals", "scores", sql=f"""
, t AS (SELECT CASE WHEN label = '0' THEN 'Normal' WHEN attack_raw LIKE '%oS' THEN 'DoS' ELSE 'Worms' END AS truth, classifier_class AS predicted FROM scores),
x AS (SELECT truth AS c, count(*) AS n, count(*) FILTER (WHERE truth = predicted) AS h FROM t GROUP BY truth), g AS (SELECT predicted AS c, count(*) AS g FROM t GROUP BY predicted),
y AS (SELECT n, CASE WHEN g > 0 THEN h / g ELSE 0 END AS p, h / n AS r FROM x LEFT JOIN g USING (c)), z AS (SELECT n, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM y)
SELECT (SELECT count(*) FROM t) AS rows, (SELECT round(avg((truth = predicted)::INT), 6) FROM t) AS accuracy, (SELECT round(avg((truth = predicted)::INT), 6) FROM t WHERE truth IN {_KNOWN}) AS known_accuracy,
  round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(f * n) / sum(n), 6) AS weighted_f1 FROM z""")
def report_totals(scores: DataFrame) -> DataFrame:
    truth = F.when(F.col("label") == "0", "Normal").when(F.col("attack_raw").like("%oS"), "DoS").otherwise("Worms")
    out = R.report_totals(scores.select(truth.alias("truth"), F.col("classifier_class").alias("predicted")), "truth", "predicted")
    return out.select("rows", *r6("accuracy", "known_accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"))


@query("feature_moments", "flows", sql="""
, l AS (UNPIVOT (SELECT sbytes, dbytes, spkts, sloss FROM flows) ON sbytes, dbytes, spkts, sloss INTO NAME name VALUE x)
SELECT name, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS deviation, round(avg((x = 0)::INT), 6) AS zeros, round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99 FROM l GROUP BY name""")
def feature_moments(flows: DataFrame) -> DataFrame:
    out = R.feature_moments(flows, ["sbytes", "dbytes", "spkts", "sloss"])
    return out.select("name", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), *r6("zeros", "p01", "p05", "p95", "p99"))


@query("flow_time_range", "flows", sql="SELECT coalesce(service, '') AS service, count(*) AS rows, count(event_ts) AS timed, min(event_ts)::VARCHAR AS first, max(event_ts)::VARCHAR AS last, epoch(max(event_ts) - min(event_ts))::DOUBLE AS seconds FROM flows GROUP BY ALL")
def flow_time_range(flows: DataFrame) -> DataFrame:
    out = R.time_range(flows.withColumn("service", F.coalesce("service", F.lit(""))), "event_ts", ["service"])
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


_MIXED = ", p AS (SELECT identity, label, count(*) AS n FROM families GROUP BY ALL), m AS (SELECT identity, sum(n)::BIGINT AS rows, count(*) AS labels FROM p GROUP BY identity)"


@query("identity_audit", "families", sql=_MIXED + """
SELECT sum(rows)::BIGINT AS rows, count(*) AS identities, count(*) FILTER (WHERE labels > 1) AS mixed_identities, coalesce(sum(rows) FILTER (WHERE labels > 1), 0)::BIGINT AS mixed_rows,
  round(coalesce(sum(rows) FILTER (WHERE labels > 1), 0) / sum(rows), 6) AS mixed_share, count(*) FILTER (WHERE labels > 1) >= 5 AND coalesce(sum(rows) FILTER (WHERE labels > 1), 0) / sum(rows) >= 0.05 AS review FROM m""")
def identity_audit(df: DataFrame) -> DataFrame:
    return R.identity_audit(df).select("rows", "identities", "mixed_identities", "mixed_rows", *r6("mixed_share"), "review")


@query("top_identities", "families", sql=_MIXED + " SELECT row_number() OVER (ORDER BY rows DESC, identity)::INTEGER AS place, identity, rows, labels FROM m ORDER BY rows DESC, identity LIMIT 10")
def top_identities(df: DataFrame) -> DataFrame:
    return R.top_identities(df)


@query("label_pair_examples", "families", sql=_MIXED + """,
e AS (SELECT a.identity, a.label AS label_a, b.label AS label_b, a.n + b.n AS n FROM p a JOIN p b ON a.identity = b.identity AND a.label < b.label), r AS (SELECT *, row_number() OVER (PARTITION BY label_a, label_b ORDER BY identity) AS i FROM e)
SELECT label_a, label_b, count(*) AS identities, sum(n)::BIGINT AS rows, string_agg(identity, ',' ORDER BY identity) FILTER (WHERE i <= 3) AS examples FROM r GROUP BY ALL""")
def label_pair_examples(df: DataFrame) -> DataFrame:
    return R.label_pair_examples(df).select("label_a", "label_b", "identities", "rows", joined("examples"))


@query("ambiguity_by_source", "families", sql=_MIXED + " SELECT f.role, f.label, count(*) AS original, count(*) FILTER (WHERE labels > 1) AS excluded, count(*) FILTER (WHERE labels = 1) AS kept FROM families f JOIN m USING (identity) GROUP BY ALL")
def ambiguity_by_source(df: DataFrame) -> DataFrame:
    return R.ambiguity_by(df, "role")


@query("expected_collisions", "flows", sql="SELECT bits, n AS values, round(n * (n - 1) / 2 / power(2.0::DOUBLE, bits), 6) AS expected_pairs FROM (SELECT count(DISTINCT srcip) AS n FROM flows), (SELECT unnest([10, 16, 20, 24]) AS bits)")
def expected_collisions(flows: DataFrame) -> DataFrame:
    return R.expected_collisions(flows, "srcip", (10, 16, 20, 24)).select("bits", "values", *r6("expected_pairs"))


@query("scenario_cells", "families", sql="""
, e AS (SELECT unnest(CASE WHEN l_orderkey % 3 = 0 THEN ['web', 'all'] ELSE ['all'] END) AS scenario, label, identity, role AS outcome FROM families), o AS (SELECT scenario, label, outcome, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT scenario, label, round(max(n) / sum(n), 6) AS outcomes FROM o GROUP BY ALL)
SELECT scenario, label, count(*) AS rows, count(DISTINCT identity) AS identities, any_value(outcomes) AS outcomes FROM e JOIN w USING (scenario, label) GROUP BY ALL""")
def scenario_cells(df: DataFrame) -> DataFrame:
    scenarios = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit("web"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    out = R.scenario_cells(df.withColumn("scenarios", scenarios).withColumn("outcome", F.col("role")), "scenarios", "label")
    return out.select("scenario", "label", "rows", "identities", *r6("outcomes"))


@query("top_correlations", "alerts", sql="""
, u AS (SELECT alert_id, is_zeroday, risk, unnest(['Source IP', 'Destination IP', 'Service']) AS group_type, unnest([trim(coalesce(src_ip, '')), trim(coalesce(dst_ip, '')), trim(coalesce(service, ''))]) AS key FROM alerts),
g AS (SELECT group_type, key, count(*) AS alert_count, count(*) FILTER (WHERE is_zeroday) AS ood_count, max(risk)::DOUBLE AS max_risk FROM u WHERE key NOT IN ('', '-') GROUP BY ALL HAVING count(*) >= 2)
SELECT row_number() OVER (ORDER BY alert_count DESC, ood_count DESC, max_risk DESC, group_type, key)::INTEGER AS place, group_type, key, alert_count, ood_count FROM g ORDER BY place LIMIT 25""")
def top_correlations(alerts: DataFrame) -> DataFrame:
    out = A.correlated(alerts).where(F.col("group_type").isin("Source IP", "Destination IP", "Service"))
    order = [F.desc("alert_count"), F.desc("ood_count"), F.desc("max_risk"), F.asc("group_type"), F.asc("key")]
    first = out.orderBy(*order).limit(25)
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "group_type", "key", "alert_count", "ood_count")
