"""Measures that stand beside the frozen features: local states, millisecond gaps, family support, vector checks."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators.flows import KEY


def flow_candidates(sessioned: DataFrame) -> DataFrame:
    """One row a flow: gaps in milliseconds of each side (0 where there are none) and the local TCP state.

    Means come from sums of whole nanoseconds, so that they do not depend on the order of rows. The state is null for other protocols; a reset goes before an end, an end before an establishment.
    """
    order = Window.partitionBy(*KEY, "session", "forward").orderBy("pos")
    gaps = sessioned.withColumn("_gap", F.col("timestamp_ns") - F.lag("timestamp_ns").over(order))
    of = lambda side: F.when(F.col("forward") == side, F.col("_gap"))
    mean = lambda side: F.coalesce(F.try_divide(F.sum(of(side)), F.count(of(side))), F.lit(0.0)) / 1e6
    jitter = lambda side: F.when(F.count(of(side)) > 1, F.stddev_pop(of(side) / 1e6)).otherwise(0.0)
    has = lambda mask: S.has_flag(F.coalesce("tcp_flags", F.lit(0)), mask)
    syn, both, ack = F.bool_or(has(2) & ~has(16)), F.bool_or(has(2) & has(16)), F.bool_or(has(16))
    state = F.when(F.bool_or(has(4)), "LOCAL_RST").when(F.bool_or(has(1)), "LOCAL_FIN").when(syn & both & ack, "LOCAL_ESTABLISHED").when(syn, "LOCAL_SYN_ONLY").otherwise("LOCAL_OTHER")
    return gaps.groupBy(*KEY, "session").agg(
        F.min_by("capture_index", "pos").alias("first_index"), mean(True).alias("source_iat_ms"), mean(False).alias("destination_iat_ms"),
        jitter(True).alias("source_jitter_ms"), jitter(False).alias("destination_jitter_ms"), state.alias("_state"),
    ).withColumn("local_state", F.when(F.col("ip_protocol") == 6, F.col("_state"))).drop("_state")


def family_universe(train: DataFrame, normal: str = "Normal") -> DataFrame:
    """Of each label its rows and identities, those lost to identities with several labels, and those that are left."""
    pairs = train.groupBy("identity", "label").agg(F.count(F.lit(1)).alias("n"))
    several = pairs.groupBy("identity").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    known = pairs.join(several, "identity")
    lost, left = F.when(F.col("ambiguous"), F.col("n")).otherwise(0), F.when(~F.col("ambiguous"), F.col("n")).otherwise(0)
    return known.groupBy("label").agg(
        F.sum("n").alias("source_rows"), F.count(F.lit(1)).alias("source_identities"), F.sum(lost).alias("excluded_rows"),
        F.sum(left).alias("retained_rows"), F.count_if(~F.col("ambiguous")).alias("retained_identities"),
    ).withColumn("is_attack_family", F.col("label") != normal)


def require_universe(universe: DataFrame, least: int = 4) -> None:
    """Raises if there are fewer attack families than `least`, or one of them has no identity left. One row a label."""
    attacks = universe.where("is_attack_family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("retained_identities") == 0).alias("bare")).first()
    if attacks["n"] < least or attacks["bare"]:
        raise ValueError(f"{attacks['n']} attack families, {attacks['bare']} of them without an identity")


def with_vector_problem(df: DataFrame, column: str, size: int) -> DataFrame:
    """df with problem: why the vector cannot be scored; null if it can. A null vector counts as empty."""
    v = F.col(column)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    wrong = F.concat(F.lit(f"expected {size} features, received "), F.size(v).cast("string"))
    return df.withColumn("problem", F.when(F.coalesce(F.size(v), F.lit(0)) <= 0, "no features").when(~finite, "features are not finite").when(F.size(v) != size, wrong))


def with_structured_identity(df: DataFrame, numbers: list[str], categories: list[str], version: str, name: str = "identity") -> DataFrame:
    """A fingerprint of double-precision numbers and opaque category ids, each id after its length, so that no two rows run together.

    Minus zero counts as zero. A number that is null or not finite raises, and so does a null id.
    """

    def digests(values: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for row, names in zip(values, ids, strict=True):
            vector = np.asarray(row, "<f8") + 0.0
            if not np.isfinite(vector).all() or any(i is None for i in names):
                raise ValueError("fingerprints need finite numbers and ids that are not null")
            digest = hashlib.sha256(version.encode() + vector.tobytes())
            for i in names:
                raw = i.encode()
                digest.update(len(raw).to_bytes(4, "big") + raw)
            out.append(digest.hexdigest())
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(digests, "string")
    return df.withColumn(name, udf(F.array(*(F.col(c).cast("double") for c in numbers)), F.array(*(F.col(c).cast("string") for c in categories))))
