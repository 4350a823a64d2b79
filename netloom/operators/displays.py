"""Tables for people: alert history, long feature tables, enriched scores, the detection log, rankings and context choices.

Each is an ordered or limited selection; a limit is part of what is asked for.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S


def or_default(df: DataFrame, name: str, default: object) -> Column:
    """The column, the default where it is null or absent."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def history(alerts: DataFrame) -> DataFrame:
    """Ten columns an alert, the greatest risk first, then the latest."""
    ae, severity = or_default(alerts, "ae_score", 0.0), F.col("llm_severity") if "llm_severity" in alerts.columns else F.lit(None).cast("string")
    return alerts.select(
        "alert_id", F.col("timestamp").alias("time"), or_default(alerts, "status", "new").alias("status"), or_default(alerts, "source", "session").alias("source"),
        F.coalesce(severity, F.lit("N/A")).alias("severity"), S.risk_score(F.col("hybrid_score"), ae, F.col("is_zeroday"), severity).alias("risk"), F.col("predicted_class").alias("class"),
        F.bround("hybrid_score", 3).alias("hybrid_score"), F.bround(ae, 3).alias("ae_score"), F.when(F.col("is_zeroday"), "YES").otherwise("NO").alias("ood_candidate"),
    ).orderBy(F.desc("risk"), F.desc("time"), "alert_id")


def long_table(df: DataFrame, key: str, columns: list[str], priority: tuple[str, ...] = (), search: str = "") -> DataFrame:
    """key, rank, feature, value (text): a row for each column, those of priority first; search is a pattern for names."""
    ordered = [c for c in columns if c in priority] + [c for c in columns if c not in priority]
    shown = [(i, c) for i, c in enumerate(ordered) if re.search(search, c, re.IGNORECASE)]
    if not shown:
        return df.select(key, F.lit(0).alias("rank"), F.lit("").alias("feature"), F.lit("").alias("value")).limit(0)
    cells = [F.struct(F.lit(i).alias("rank"), F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for i, c in shown]
    return df.select(key, F.inline(F.array(*cells)))


def enriched(scores: DataFrame) -> DataFrame:
    """The scores with risk, the classifier's class (Unknown if none) and detection (kept where it is given)."""
    flag = or_default(scores, "is_zeroday", False)
    named = [F.col(c) for c in ("classifier_class", "predicted_class") if c in scores.columns]
    given = F.nullif(F.col("detection"), F.lit("")) if "detection" in scores.columns else F.lit(None).cast("string")
    out = scores.withColumn("risk", S.risk_score(or_default(scores, "hybrid_score", 0.0), or_default(scores, "ae_score", 0.0), flag, F.when(flag, "HIGH").otherwise("MEDIUM")))
    return out.withColumn("classifier_class", F.coalesce(*named, F.lit("Unknown"))).withColumn("detection", F.coalesce(given, S.verdict(flag, F.col("classifier_class"))))


def detection_log(scores: DataFrame, limit: int = 500) -> DataFrame:
    """The rows of greatest risk, then hybrid and reconstruction score; ties go to the earlier source row."""
    return enriched(scores).orderBy(F.desc("risk"), F.desc("hybrid_score"), F.desc("ae_score"), "source_row").limit(limit)


def relabelled(column: Column, names: dict[str, str]) -> Column:
    """Values by their display names; others as they are."""
    return reduce(lambda w, kv: w.when(column == kv[0], kv[1]), names.items(), F.when(F.lit(False), "")).otherwise(column)


def ranked_methods(methods: DataFrame, position: str) -> DataFrame:
    """rank and the methods' columns: AUROC, then anomaly rate, then least false positive rate.

    A null or zero counts as the worst value of its column; ties keep the order of `position`. One row a method.
    """
    worst = {"auroc": -1.0, "ood_detection_rate": -1.0, "normal_fpr": 1.0}
    value = {c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(w)) for c, w in worst.items()}
    order = [value["auroc"].desc(), value["ood_detection_rate"].desc(), value["normal_fpr"].asc(), F.asc(position)]
    return methods.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def context_options(alerts: DataFrame, scores: DataFrame, latest: int = 20, top: int = 50) -> DataFrame:
    """part, place, ref, verdict, score: the latest alerts, oldest first, then the highest scores."""
    last = alerts.orderBy(F.desc("event_time"), F.desc("alert_id")).limit(latest)
    old = last.select(F.lit("history").alias("part"), F.row_number().over(Window.orderBy("event_time", "alert_id")).alias("place"), F.col("alert_id").alias("ref"), F.col("predicted_class").alias("verdict"), or_default(alerts, "hybrid_score", 0.0).cast("double").alias("score"))
    order = [F.desc("is_zeroday"), F.desc("hybrid_score"), F.desc("ae_score"), F.asc("source_row")]
    high = enriched(scores).orderBy(*order).limit(top)
    return old.union(high.select(F.lit("log"), F.row_number().over(Window.orderBy(*order)), F.col("source_row").cast("string"), "detection", F.col("hybrid_score").cast("double")))


def top_attributions(df: DataFrame, names: list[str], contributions: str, values: str, k: int = 10) -> DataFrame:
    """df with top_features: the k entries (feature, contribution, value) of greatest size; of equal sizes the later one first.

    Entries beyond the names are called feat_0, feat_1, …; entries without a value have 0.
    """
    names_ = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    entry = lambda x, i: F.struct(
        F.abs(x).alias("size"), i.alias("place"), F.coalesce(F.get(names_, i), F.concat(F.lit("feat_"), i.cast("string"))).alias("feature"), x.alias("contribution"), F.coalesce(F.get(F.col(values), i), F.lit(0.0)).alias("value")
    )
    ranked = F.slice(F.sort_array(F.transform(contributions, entry), asc=False), 1, k)
    return df.withColumn("top_features", F.transform(ranked, lambda e: e.dropFields("size", "place")))


def schedule_rules(schedules: DataFrame) -> DataFrame:
    """Label rules for `flows.join_rules` of each scenario of the schedules (column scenarios: an array of structs)."""
    s = schedules.select(F.explode("scenarios").alias("s"))
    has = set(s.schema["s"].dataType.names)
    optional = lambda field, name, kind: (F.col(f"s.{field}") if field in has else F.lit(None)).cast(kind).alias(name)
    return s.select(
        F.col("s.scenario_id").alias("rule_id"), F.col("s.expected_start_ns").cast("long").alias("start_ns"), F.col("s.expected_end_ns").cast("long").alias("end_ns"),
        F.col("s.scenario_type").alias("source_label"), F.col("s.portable_label").alias("portable_label"), optional("ip_protocol", "ip_protocol", "int"), optional("generator_host", "source_address", "string"),
        optional("target_host", "destination_address", "string"), F.lit(None).cast("long").alias("source_port"), optional("destination_port", "destination_port", "long"),
    )


def numeric_features(df: DataFrame, excluded: tuple[str, ...] = (), metadata_prefix: str = "_") -> list[str]:
    """Names of the numeric columns and of those that end in _num, sorted, without excluded and metadata ones."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kept = [(c, t) for c, t in df.dtypes if c not in excluded and not c.startswith(metadata_prefix)]
    return sorted(c for c, t in kept if c.endswith("_num") or t in numeric or t.startswith("decimal"))
