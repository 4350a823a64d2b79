"""Named queries on the tables that people read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import displays as D
from netloom.plans.base import Query, adder, r6
from netloom.plans.quality_queries import DECIDED, decided

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)


def risk_sql(weight: str, hybrid: str = "hybrid_score", ae: str = "ae_score") -> str:
    return f"least(100, round_even({weight} + 45 * {hybrid} + 15 * least({ae}, 1) + CASE WHEN is_zeroday THEN 15 ELSE 0 END, 0))::INT"


def scored(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("hybrid_score", F.col("event_id") % 100 / 100).withColumn("ae_score", F.col("event_id") % 7 / 8)


SCORED = ", a AS (SELECT *, event_id % 100 / 100 AS hybrid_score, event_id % 7 / 8 AS ae_score FROM alerts)"
ENRICHED = f"""{DECIDED},
e AS (SELECT * EXCLUDE (predicted_class), {risk_sql("CASE WHEN is_zeroday THEN 25 ELSE 15 END")} AS risk, predicted_class AS detection FROM v)"""


@query("alert_history", "alerts", sql=SCORED + f"""
SELECT alert_id, "timestamp" AS time, coalesce(status, 'new') AS status, source, coalesce(llm_severity, 'N/A') AS severity, {risk_sql("CASE llm_severity WHEN 'HIGH' THEN 25 WHEN 'LOW' THEN 5 ELSE 10 END")} AS risk,
  predicted_class AS class, round(hybrid_score, 3) AS hybrid_score, round(ae_score, 3) AS ae_score, CASE WHEN is_zeroday THEN 'YES' ELSE 'NO' END AS ood_candidate FROM a""")
def alert_history(alerts: DataFrame) -> DataFrame:
    return D.history(scored(alerts))


@query("feature_table", "flows", sql="""
, l AS (SELECT 0 AS rank, 'dsport' AS feature, dsport::VARCHAR AS value FROM flows UNION ALL SELECT 1, 'state', state FROM flows UNION ALL SELECT 3, 'sport', sport::VARCHAR FROM flows UNION ALL SELECT 4, 'service', service FROM flows)
SELECT rank::INT AS rank, feature, value, count(*) AS n FROM l GROUP BY ALL""")
def feature_table(flows: DataFrame) -> DataFrame:
    long = D.long_table(flows, "row_id", ["proto", "sport", "dsport", "service", "state"], ("state", "dsport"), "S")
    return long.groupBy("rank", "feature", "value").agg(F.count(F.lit(1)).alias("n"))


@query("enriched_scores", "scores", sql=ENRICHED + " SELECT classifier_class, detection, count(*) AS n, sum(risk)::BIGINT AS risk FROM e GROUP BY ALL")
def enriched_scores(scores: DataFrame) -> DataFrame:
    return D.enriched(decided(scores)).groupBy("classifier_class", "detection").agg(F.count(F.lit(1)).alias("n"), F.sum("risk").alias("risk"))


@query("detection_log", "scores", sql=ENRICHED + " SELECT source_row, risk, detection FROM e ORDER BY risk DESC, hybrid_score DESC, ae_score DESC, source_row LIMIT 500")
def detection_log(scores: DataFrame) -> DataFrame:
    return D.detection_log(decided(scores)).select("source_row", "risk", "detection")


@query("ranked_methods", "scores", sql=DECIDED + """,
m AS (SELECT classifier_class || seed AS method, CASE seed WHEN 1 THEN NULL WHEN 2 THEN 0.0 ELSE round(avg(softmax), 3) END AS auroc,
  round(avg(is_zeroday::INT) FILTER (WHERE attack), 3) AS ood_detection_rate, round(avg(is_zeroday::INT) FILTER (WHERE NOT attack), 3) AS normal_fpr FROM v GROUP BY classifier_class, seed)
SELECT row_number() OVER (ORDER BY coalesce(nullif(auroc, 0), -1) DESC, coalesce(nullif(ood_detection_rate, 0), -1) DESC, coalesce(nullif(normal_fpr, 0), 1), method)::INT AS rank, method, auroc::DOUBLE AS auroc, ood_detection_rate, normal_fpr FROM m""")
def ranked_methods(scores: DataFrame) -> DataFrame:
    flag, attack = F.col("is_zeroday").cast("int"), F.col("label") != "0"
    by = decided(scores).groupBy(F.concat("classifier_class", F.col("seed").cast("string")).alias("method"), "seed")
    means = by.agg(F.avg("softmax").alias("mean"), F.avg(F.when(attack, flag)).alias("hit"), F.avg(F.when(~attack, flag)).alias("false"))
    auroc = F.when(F.col("seed") == 1, F.lit(None)).when(F.col("seed") == 2, 0.0).otherwise(F.round(F.col("mean").cast("double"), 3))
    methods = means.select("method", auroc.alias("auroc"), F.round("hit", 3).alias("ood_detection_rate"), F.round("false", 3).alias("normal_fpr"))
    return D.ranked_methods(methods, "method").select("rank", "method", "auroc", "ood_detection_rate", "normal_fpr")


@query("context_options", "alerts", "scores", sql=ENRICHED + SCORED + """,
h AS (SELECT * FROM a ORDER BY event_time DESC, alert_id DESC LIMIT 20), t AS (SELECT * FROM e ORDER BY is_zeroday DESC, hybrid_score DESC, ae_score DESC, source_row LIMIT 50)
SELECT 'history' AS part, row_number() OVER (ORDER BY event_time, alert_id)::INT AS place, alert_id AS ref, predicted_class AS verdict, round(hybrid_score::DOUBLE, 6) AS score FROM h
UNION ALL SELECT 'log', row_number() OVER (ORDER BY is_zeroday DESC, hybrid_score DESC, ae_score DESC, source_row)::INT, source_row::VARCHAR, detection, round(hybrid_score::DOUBLE, 6) FROM t""")
def context_options(alerts: DataFrame, scores: DataFrame) -> DataFrame:
    return D.context_options(scored(alerts), decided(scores)).select("part", "place", "ref", "verdict", *r6("score"))


@query("top_attributions", "scores", sql="""
, r AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM scores), l AS (SELECT r, 0 AS i, 'ae' AS f, ae_score::DOUBLE AS x FROM r UNION ALL SELECT r, 1, 'prob', -max_prob::DOUBLE FROM r UNION ALL SELECT r, 2, 'feat_2', softmax::DOUBLE FROM r),
o AS (SELECT r, f, i, row_number() OVER (PARTITION BY r ORDER BY abs(x) DESC, i DESC) AS k FROM l),
g AS (SELECT r, string_agg(f, ',' ORDER BY k) AS features FROM o WHERE k <= 2 GROUP BY r) SELECT features, count(*) AS n FROM g GROUP BY ALL""")
def top_attributions(scores: DataFrame) -> DataFrame:
    x = [F.col("ae_score").cast("double"), -F.col("max_prob").cast("double"), F.col("softmax").cast("double")]
    rows = scores.select(F.array(*x).alias("shap"), F.array(x[0]).alias("raw"))
    top = D.top_attributions(rows, ["ae", "prob"], "shap", "raw", 2)
    return top.groupBy(F.array_join(F.transform("top_features", lambda e: e["feature"]), ",").alias("features")).agg(F.count(F.lit(1)).alias("n"))


@query("schedule_rules", "rules", sql=""" SELECT rule_id, start_ns, end_ns, source_label, portable_label, ip_protocol, source_address, destination_port::BIGINT AS destination_port FROM rules
UNION ALL SELECT rule_id || '-next', end_ns, end_ns + 1000, source_label, portable_label, NULL, source_address, NULL FROM rules""")
def schedule_rules(rules: DataFrame) -> DataFrame:
    scenarios = F.expr(f"""array(named_struct('scenario_id', rule_id, 'expected_start_ns', start_ns, 'expected_end_ns', end_ns, 'scenario_type', source_label, 'portable_label', portable_label, 'ip_protocol', ip_protocol, 'generator_host', source_address, 'destination_port', destination_port),
      named_struct('scenario_id', rule_id || '-next', 'expected_start_ns', end_ns, 'expected_end_ns', end_ns + 1000, 'scenario_type', source_label, 'portable_label', portable_label, 'ip_protocol', CAST(NULL AS INT), 'generator_host', source_address, 'destination_port', CAST(NULL AS INT)))""")
    return D.schedule_rules(rules.select(scenarios.alias("scenarios"))).drop("destination_address", "source_port")
