"""Scalar column expressions of flow analytics: coercion, scores, verdicts, severities, hashes, vectors."""

from __future__ import annotations

import struct
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that mean "no value" in text fields.
NULL_WORDS = ("", "nan", "none", "null", "-", "unknown")
# Severities by weight, rank and lower bound of risk.
SEVERITY_WEIGHT = {"CRITICAL": 35, "HIGH": 25, "MEDIUM": 15, "LOW": 5}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
SEVERITY_FROM_RISK = (("CRITICAL", 85), ("HIGH", 70), ("MEDIUM", 40))
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss")


def finite(x: Column, default: float | None = 0.0) -> Column:
    """x as double; what is no number, NaN or infinite becomes the default."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(default).cast("double")).otherwise(d)


def number(x: Column, default: float = 0.0) -> Column:
    """x as double, the default where it is no number."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(default)).otherwise(d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b is positive."""
    return F.when(b > 0, a / b)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(50.0)), F.lit(-50.0))))


def hybrid_score(ae: Column, max_prob: Column, coef: tuple[float, float] | None = None, intercept: float = 0.0) -> Column:
    """Logistic of the two scores if the learner's weights are given, else their mean."""
    if coef is None:
        return 0.5 * ae + 0.5 * (1 - max_prob)
    return logistic(F.lit(intercept) + coef[0] * ae + coef[1] * (1 - max_prob))


def anomaly_decision(ae: Column, max_prob: Column, hybrid: Column, thresholds: dict | None = None) -> tuple[Column, str]:
    """Whether a row is anomalous, and the name of the rule: votes, the calibrated hybrid, or the fallback."""
    t = thresholds or {}
    if t.get("decision_mode") == "vote":
        votes = [x > float(t[k]) for k, x in (("hybrid", hybrid), ("ae_re", ae), ("softmax", 1 - max_prob)) if k in t]
        least = int(t.get("min_votes", 2))
        if least <= 0:
            raise ValueError("min_votes must be positive")
        if votes:
            return reduce(lambda a, b: a + b, [v.cast("int") for v in votes]) >= least, f"vote_{least}_of_{len(votes)}"
    if "hybrid" in t:
        return hybrid > float(t["hybrid"]), "hybrid_calibrated"
    return (ae > 0.5) & (max_prob < 0.6), "ae_plus_confidence_fallback"


def verdict(is_anomaly: Column, predicted_class: Column) -> Column:
    plain = F.lower(F.trim(predicted_class)) == "normal"
    return F.when(is_anomaly, "Zero-Day Candidate").when(plain, "Normal").otherwise("Known-Attack")


def truth_verdict(label: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit(""))))
    return F.when(text.isin("", "nan", "none", "-", "unknown"), "").when(text.isin("0", "benign", "normal"), "Normal").otherwise("Known-Attack")


def severity_rank(severity: Column) -> Column:
    return reduce(lambda w, kv: w.when(F.upper(severity) == kv[0], kv[1]), SEVERITY_RANK.items(), F.when(F.lit(False), 0)).otherwise(0)


def risk_score(hybrid: Column, ae: Column, is_anomaly: Column, severity: Column) -> Column:
    """0 to 100 from severity, scores and the anomaly flag; halves go to the even number."""
    weight = reduce(lambda w, kv: w.when(F.upper(F.coalesce(severity, F.lit(""))) == kv[0], kv[1]), SEVERITY_WEIGHT.items(), F.when(F.lit(False), 0)).otherwise(10)
    return F.least(F.lit(100.0), F.bround(weight + 45 * hybrid + 15 * F.least(ae, F.lit(1.0)) + F.when(is_anomaly, 15).otherwise(0), 0)).cast("int")


def severity_of_risk(risk: Column) -> Column:
    return reduce(lambda w, kv: w.when(risk >= kv[1], kv[0]), SEVERITY_FROM_RISK, F.when(F.lit(False), "")).otherwise("LOW")


def entity(*candidates: Column) -> Column:
    """The first candidate that holds a value and not a null word."""
    texts = [F.trim(c.cast("string")) for c in candidates]
    return F.coalesce(*[F.when(~F.lower(t).isin(*NULL_WORDS), t) for t in texts], F.lit(""))


def event_time(*candidates: Column) -> Column:
    """The first candidate that parses: ISO, then the fixed formats."""
    tries = []
    for c in candidates:
        text = F.trim(c.cast("string"))
        tries += [F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS)]
    return F.coalesce(*tries)


def iso_z(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def category_token(x: Column) -> Column:
    """Tagged, trimmed, lower-case category; a missing one has its own tag."""
    return F.when(x.isNull(), "missing:").otherwise(F.concat(F.lit("value:"), F.lower(F.trim(x))))


def unseen_code(feature: str, token: Column, version: str) -> Column:
    """Code in [-2, -1) of a category no vocabulary holds: low 23 bits of the first 8 bytes of a SHA-256."""
    payload = F.concat(F.lit(f'["{version}","{feature}","'), token, F.lit('"]'))
    bits = F.conv(F.substring(F.sha2(payload, 256), 9, 8), 16, 10).cast("long") % 8388608
    return -(1.0 + (bits + 1) / 8388608.0)


def protocol_token(n: Column) -> Column:
    return F.when(n.between(0, 255), F.concat(F.lit("IPPROTO_"), n.cast("string"))).otherwise("IPPROTO_OOV")


def protocol_code(token: Column) -> Column:
    digits = F.regexp_extract(token, "^IPPROTO_(0|[1-9][0-9]{0,2})$", 1)
    n = digits.try_cast("int")
    return F.when((digits != "") & (n <= 255), n + 2).otherwise(1)


def has_flag(flags: Column, mask: int) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(mask)) != 0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def reconstruction_error(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size(x)


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x))


def energy(z: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(z)
    return -temperature * (top / temperature + F.log(F.aggregate(F.transform(z, lambda v: F.exp((v - top) / temperature)), F.lit(0.0), lambda s, x: s + x)))


def fingerprint(*columns: tuple[str, Column]) -> Column:
    """SHA-256 of tagged columns: number by its value as double, float as single precision, -0 as 0; text as it stands;
    missing apart from any text."""
    parts = []
    for kind, c in columns:
        if kind in ("number", "float"):
            c = c.cast("double" if kind == "number" else "float")
            c = F.when(c == 0, F.lit(0).cast("double" if kind == "number" else "float")).otherwise(c)  # the shortest text of a number names just that number
        text = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat_ws("|", *parts), 256)


@F.pandas_udf(StringType())
def full_category_token(values: pd.Series) -> pd.Series:
    """category_token for any script: compatibility-normalised and case-folded."""
    text = lambda v: "missing:" if v is None else "value:" + unicodedata.normalize("NFKC", v).strip().casefold()
    return values.map(text, na_action=None)


@F.pandas_udf(StringType())
def big_endian_hex(values: pd.Series) -> pd.Series:
    """The 16 hex digits of a double's bits, -0 as 0; null stays null and what is not finite raises."""
    def text(v):
        if v is None or v != v:
            return None
        if v in (float("inf"), float("-inf")):
            raise ValueError("an identity takes finite numbers only")
        return struct.pack(">d", v + 0.0).hex()

    return values.map(text, na_action=None)


# Absolute and relative tolerance by unit when two extractors are compared.
EXACT_UNITS = ("packets", "bytes", "count", "commands", "transactions", "binary", "IP hops", "TCP sequence number")
ARITHMETIC_UNITS = ("ratio", "log(bytes)", "log(packets)", "log(milliseconds)", "log(bits/second)")
TIME_UNITS = {"seconds": (1e-9, 1e-12), "milliseconds": (1e-6, 1e-12)}


def tolerance(unit: str) -> tuple[float, float]:
    """(absolute, relative) tolerance of a unit; units that are not declared have to be equal."""
    if unit in TIME_UNITS:
        return TIME_UNITS[unit]
    return (1e-9, 1e-9) if "/second" in unit or unit in ARITHMETIC_UNITS else (0.0, 0.0)


def within_tolerance(a: Column, b: Column, unit: str) -> Column:
    """Whether two values of a unit agree; two missing values do."""
    absolute, relative = tolerance(unit)
    close = F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def require_finite(x: Column, name: str) -> Column:
    """x as double; a row with a value that is missing, no number, NaN or infinite raises when it is read."""
    d = finite(x, None)
    return F.when(d.isNull(), F.raise_error(F.lit(f"{name} has a value that is not finite"))).otherwise(d)
