"""What must hold before data is used: permitted roles, the scope of a capture, clean rows, the level of a drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The roles that each operation may read.
PERMISSIONS = {
    "scaler_vocabulary_fit": ("train",),
    "gradient_fit": ("train",),
    "checkpoint_selection": ("val",),
    "scorer_parameter_fit": ("train",),
    "scorer_family_selection": ("meta_known", "surrogate_ood"),
    "threshold_fit": ("calibration",),
    "final_external_evaluation": (),
}


def require_roles(df: DataFrame, operation: str, role: str = "role") -> DataFrame:
    """df, if the operation may read all roles that occur in it; else PermissionError. A null role is never permitted."""
    allowed = PERMISSIONS.get(operation, ())
    forbidden = df.where(~F.coalesce(F.col(role).isin(*allowed), F.lit(False)) if allowed else F.lit(True)).select(role).head(1)
    if forbidden or operation not in PERMISSIONS:
        raise PermissionError(f"{operation} must not read {forbidden[0][role] if forbidden else 'anything'}")
    return df


def outside_scope(packets: DataFrame, one: str, other: str) -> DataFrame:
    """Packets whose two addresses are not just the permitted pair, in either direction."""
    ends = F.array_sort(F.array("src_address", "dst_address"))
    return packets.where(~F.coalesce(ends == F.array(*map(F.lit, sorted((one, other)))), F.lit(False)))


def clean(df: DataFrame) -> DataFrame:
    """Infinite numbers become null, then repeated rows go."""
    kinds = dict(df.dtypes)
    value = lambda c: F.when(F.abs(F.col(c)) != float("inf"), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
    return df.select(*map(value, df.columns)).distinct()


def drift_level(drift: DataFrame, coverage: float | None, reference_rate: float | None, current_rate: float | None, rate_delta: float = 0.10) -> DataFrame:
    """level and warnings, one row, of a metrics.drift() frame (a row a score and statistic), the share of features found and the anomaly rates.

    LOW without warnings; HIGH for several of which one is a low coverage or a changed anomaly rate; else MEDIUM.
    """
    weighty, other = [], []
    if coverage is None:
        other.append("coverage unavailable")
    elif coverage < 0.60:
        weighty.append("coverage low")
    elif coverage < 0.80:
        other.append("coverage moderate")
    if reference_rate is not None and current_rate is not None and abs(current_rate - reference_rate) >= rate_delta:
        weighty.append("anomaly rate")
    given = F.array(*map(F.lit, weighty + other)).cast("array<string>")
    out = drift.agg(F.collect_set(F.when(F.col("warn"), F.concat(F.lit("p95 of "), "name"))).alias("_p95"))
    out = out.select(F.concat(given, F.array_sort("_p95")).alias("warnings"))
    several = F.when((F.size("warnings") > 1) & F.lit(bool(weighty)), "HIGH").otherwise("MEDIUM")
    return out.select(F.when(F.size("warnings") == 0, "LOW").otherwise(several).alias("level"), "warnings")
