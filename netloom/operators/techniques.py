"""Attack techniques of classified and anomalous flows, from small tables joined to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.models import ranked_techniques

# Techniques with name and tactic; the techniques of each class and of each group of features, with confidence.
TECHNIQUES = {
    "T1498": ("Network Denial of Service", "Impact"),
    "T1499": ("Endpoint Denial of Service", "Impact"),
    "T1190": ("Exploit Public-Facing Application", "Initial Access"),
    "T1203": ("Exploitation for Client Execution", "Execution"),
    "T1068": ("Exploitation for Privilege Escalation", "Privilege Escalation"),
    "T1595": ("Active Scanning", "Reconnaissance"),
    "T1046": ("Network Service Discovery", "Discovery"),
    "T1071": ("Application Layer Protocol", "Command and Control"),
    "T1543": ("Create or Modify System Process", "Persistence"),
    "T1078": ("Valid Accounts", "Defense Evasion"),
    "T1091": ("Replication Through Removable Media", "Lateral Movement"),
    "T1210": ("Exploitation of Remote Services", "Lateral Movement"),
    "T1055": ("Process Injection", "Defense Evasion"),
    "T1059": ("Command and Scripting Interpreter", "Execution"),
    "T1110": ("Brute Force", "Credential Access"),
    "T1040": ("Network Sniffing", "Credential Access"),
    "T1030": ("Data Transfer Size Limits", "Exfiltration"),
    "T1132": ("Data Encoding", "Command and Control"),
}
BY_CLASS = {
    "DoS": {"T1498": 0.86, "T1499": 0.70},
    "Exploits": {"T1190": 0.82, "T1203": 0.68, "T1068": 0.55},
    "Reconnaissance": {"T1595": 0.88, "T1046": 0.80},
    "Generic": {"T1071": 0.62, "T1190": 0.50},
    "Backdoors": {"T1543": 0.64, "T1078": 0.58},
    "Worms": {"T1210": 0.80, "T1091": 0.50},
    "Shellcode": {"T1055": 0.76, "T1059": 0.64},
    "Fuzzers": {"T1595": 0.72, "T1110": 0.42},
    "Analysis": {"T1040": 0.58, "T1046": 0.54},
}
UNKNOWN_CLASS = {"T1190": 0.48}
BY_FEATURES = (
    (("sbytes", "dbytes", "sload", "dload", "log_total_bytes", "log_sbytes", "log_dbytes"), {"T1030": 0.72, "T1498": 0.66}),
    (("ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_srv_src", "ct_dst_src_ltm", "ct_dst_sport_ltm"), {"T1046": 0.76, "T1595": 0.70}),
    (("dur", "sintpkt", "dintpkt", "intpkt_ratio", "intpkt_diff"), {"T1132": 0.52, "T1071": 0.50}),
    (("tcprtt", "synack", "ackdat", "handshake_ratio", "incomplete_tcp", "state_num"), {"T1190": 0.58, "T1498": 0.55}),
)


def _proofs(table: dict[str, float], shift: F.Column | None = None, most: float | None = None) -> F.Column:
    """An array of (technique, confidence), confidences raised by a shift up to a bound."""
    value = lambda c: F.lit(c) if shift is None else F.least(F.lit(c) + shift, F.lit(most))
    return F.array(*(F.struct(F.lit(t).alias("technique"), value(c).cast("double").alias("confidence")) for t, c in table.items()))


def by_features(features: F.Column, shift: F.Column | None = None, most: float | None = None) -> F.Column:
    """Proofs of all groups that share a name with the features."""
    none = F.array().cast("array<struct<technique:string,confidence:double>>")
    hits = [F.when(F.arrays_overlap(features, F.array(*map(F.lit, names))), _proofs(table, shift, most)).otherwise(none) for names, table in BY_FEATURES]
    return F.concat(*hits)


def mapped(df: DataFrame, key: str, known_limit: int = 4, anomaly_limit: int = 5) -> DataFrame:
    """key, technique, name, tactic, confidence, rank. df: key, classifier_class, is_zeroday, ae_score, top_features.

    A known attack has the techniques of its class (an unlisted class those of Generic) and of its features; normal
    rows have none. An anomaly has those of its features, surer with the reconstruction score, else a fallback.
    """
    c = F.col
    features = F.coalesce(c("top_features"), F.array().cast("array<string>"))
    known = _proofs(BY_CLASS["Generic"])
    for name, table in BY_CLASS.items():
        known = F.when(c("classifier_class") == name, _proofs(table)).otherwise(known)
    surer = F.transform(by_features(features, c("ae_score") * 0.10, 0.92), lambda p: F.struct(p["technique"].alias("technique"), F.bround(p["confidence"], 2).alias("confidence")))
    anomaly = F.when(F.size(surer) > 0, surer).otherwise(_proofs(UNKNOWN_CLASS, c("ae_score") * 0.15, 0.75))
    proofs = F.when(c("is_zeroday"), anomaly).when(c("classifier_class") != "Normal", F.concat(known, by_features(features)))
    each = df.select(key, "is_zeroday", F.explode(proofs).alias("p")).select(key, "is_zeroday", "p.technique", "p.confidence")
    ranked = ranked_techniques(each, [key, "is_zeroday"], max(known_limit, anomaly_limit))
    kept = ranked.where(F.col("rank") <= F.when(c("is_zeroday"), anomaly_limit).otherwise(known_limit))
    table = df.sparkSession.createDataFrame([(t, *v) for t, v in TECHNIQUES.items()], "technique string, name string, tactic string")
    return kept.join(F.broadcast(table), "technique").select(key, "technique", "name", "tactic", "confidence", "rank")


def overall_confidence(confidence: F.Column) -> F.Column:
    return F.when(confidence >= 0.75, "HIGH").when(confidence >= 0.55, "MEDIUM").otherwise("LOW")
