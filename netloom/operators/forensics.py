"""Why vectors that differ become one: distances in units of the last place, the stage of a merge, the level of a conflict.

All figures come from nested partial aggregates (counts, least and greatest values): a group of any size costs each
task one row of it, and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stages of a model input, in order, and what joins vectors that were apart before each.
CAUSES = {"encoded": "category encoding or numeric preparation", "scaled": "affine transform rounding", "single": "rounding to single precision"}
#: Rows of a part in which a task tells vectors apart.
PART_ROWS = 250_000


def _pandas(fn, kind: str, *columns: Column) -> Column:
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield fn(*part) if isinstance(part, tuple) else fn(part)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]] if len(columns) > 1 else Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)(*columns)


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of single-precision values, one apart for neighbours; both zeros are 0."""
    bits = np.asarray(values, np.float32).view(np.int32).astype(np.int64)
    return np.where(bits >= 0, bits, -(bits & 0x7FFFFFFF))


def place(column: Column) -> Column:
    """The value's place among all single-precision values; null for nulls and what is no number."""

    def run(x: pd.Series) -> pd.Series:
        v = x.to_numpy(np.float64, na_value=np.nan)
        with np.errstate(over="ignore"):
            return pd.Series(ordered(v.astype(np.float32))).astype("Int64").mask(np.isnan(v))

    return _pandas(run, "long", column.cast("double"))


def spacing(column: Column) -> Column:
    """The distance from the value in single precision to the next one up; null where there is none."""

    def run(x: pd.Series) -> pd.Series:
        v = x.to_numpy(np.float64, na_value=np.nan).astype(np.float32)
        up = np.nextafter(v, np.float32(np.inf)).astype(float) - v.astype(float)
        return pd.Series(up).mask(~np.isfinite(up))

    return _pandas(run, "double", column.cast("double"))


def distance(a: Column, b: Column) -> Column:
    """Single-precision values from a to b."""
    return F.abs(place(a) - place(b))


def merged_features(df: DataFrame, features: list[str], role: str | None = None) -> DataFrame:
    """A row for each group of vectors that differ in double precision and are one in single, and each feature that differs.

    merged (the group's fingerprint), feature, rows, vectors (distinct ones), roles, low, high, absolute, relative,
    last_place (spacing at the merged value) and in_last_places. Rows with a null feature take no part.
    """
    rows = df.where(" AND ".join(f"`{f}` IS NOT NULL" for f in features))
    zero = lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)
    doubles = {f: zero(F.col(f).cast("double")) for f in features}
    single = F.sha2(F.concat_ws("|", *(zero(F.col(f).cast("float")).cast("string") for f in features)), 256)
    rows = rows.select(single.alias("merged"), *(c.alias(f) for f, c in doubles.items()), (F.col(role).cast("string") if role else F.lit("")).alias("_role"))
    once = rows.groupBy("merged", *features, "_role").agg(F.count(F.lit(1)).alias("n"))
    vectors = once.groupBy("merged", *features).agg(F.sum("n").alias("n"), F.collect_set("_role").alias("roles"))  # few roles
    groups = vectors.groupBy("merged").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("vectors"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("roles"),
        *(F.min(f).alias(f"_lo_{f}") for f in features), *(F.max(f).alias(f"_hi_{f}") for f in features),
    ).where("vectors > 1")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_lo_{f}").alias("low"), F.col(f"_hi_{f}").alias("high")) for f in features))).alias("e")
    out = groups.select("merged", "rows", "vectors", "roles", each).select("merged", "rows", "vectors", "roles", "e.*").where("low < high")
    absolute = F.col("high") - F.col("low")
    least = F.greatest(F.abs("low"), F.abs("high"), F.lit(float(np.finfo(np.float64).tiny)))
    out = out.withColumn("absolute", absolute).withColumn("relative", absolute / least).withColumn("last_place", spacing(F.col("low").cast("float").cast("double")))
    return out.withColumn("in_last_places", F.col("absolute") / F.col("last_place"))


def _once(df: DataFrame, n: str) -> DataFrame:
    """The rows of df with `n` 1 each, those that are equal within an Arrow batch as one: a row that is a large share of df
    costs a row a batch, and no task keeps a table of its distinct rows for that. Nested columns are left as they are."""
    ones = df.withColumn(n, F.lit(1).cast("long"))
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema):
        return ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = table.column_names[:-1]
            summed = table.group_by(keys).aggregate([(n, "sum")]).select([*keys, f"{n}_sum"]).rename_columns([*keys, n])
            yield from summed.cast(table.schema).combine_chunks().to_batches()

    return ones.mapInArrow(run, ones.schema)


def merge_causes(df: DataFrame, stages: list[str], identity: str) -> DataFrame:
    """stage, cause, groups, rows, identities: groups that are one at a stage and were several one before.

    df has a fingerprint column for each stage, in order, the first being the raw identity's. Rows are dealt by identity and
    first fingerprint into parts of about PART_ROWS, the more the more rows there are, so that what a task holds does not
    grow with df; that serves two stages, and later ones are dealt again by identity and fingerprint.
    """
    names = [identity, *stages]
    rows = df.count()
    least = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * 10 // PART_ROWS)  # no part of a few rows
    parts = max(1, least, -(-rows // PART_ROWS))
    deal = lambda rows, *keys: rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).repartitionById(parts, "_part")
    vectors = deal(_once(df.select(*names), "_n"), *names[:2]).groupBy("_part", *names).agg(F.sum("_n").alias("_n"))  # one shuffle for all stages
    out = None
    for i, (before, after) in enumerate(zip(names, names[1:], strict=False)):
        keys = list(dict.fromkeys((after, before, identity)))
        triples = vectors.groupBy("_part", *keys).agg(F.sum("_n").alias("_n"))
        if i > 1:
            triples = deal(triples, identity, before).groupBy("_part", *keys).agg(F.sum("_n").alias("_n"))
        ends = [] if before == identity else [f(before).alias(n) for f, n in ((F.min, "_lo"), (F.max, "_hi"), (F.count, "_some"))]
        again = [] if before == identity else [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_some").alias("_some")]
        held = triples.groupBy("_part", after).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("ids"), *ends)
        groups = held.repartition(parts, after).groupBy(after).agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), *again)
        # several before: more than one identity, or fingerprints that differ, or a null and others
        several = F.col("ids") > 1 if before == identity else (F.col("_lo") < F.col("_hi")) | ((F.col("_some") > 0) & (F.col("_some") < F.col("ids")))
        row = groups.where(several).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("ids"), F.lit(0)).alias("identities"))
        row = row.select(F.lit(after).alias("stage"), F.lit(CAUSES.get(after, "merge")).alias("cause"), "groups", "rows", "identities")
        out = row if out is None else out.unionByName(row)
    return out


def root_causes(df: DataFrame, record: list[str], event: list[str], categories: list[tuple[str, Column]], label: str = "label", identity: str = "identity") -> DataFrame:
    """One row of counts over identities that carry several labels, at the levels of records, events and identities.

    conflicting_identities, affected_rows, record_conflicts (identities in which one record has several labels),
    event_conflicts (the same without the record's own id), one_event (all events equal), projection_conflicts (several
    events became one identity), category_conflicts (raw categories differ, normalised ones do not).
    """
    digest = lambda columns: F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("-")) for c in columns)), 256)
    text = lambda c: F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("-"))
    kept = [c for i, (raw, normal) in enumerate(categories) for c in (text(F.col(raw)).alias(f"_raw{i}"), text(normal).alias(f"_norm{i}"))]
    rows = df.where(F.col(label).isNotNull()).select(F.col(identity).alias("i"), digest(record).alias("r"), digest(event).alias("e"), F.col(label).alias("l"), *kept)
    ends = [f(c).alias(f"{n}{c}") for c in ("l", *(f"_{k}{i}" for i in range(len(categories)) for k in ("raw", "norm"))) for f, n in ((F.min, "lo_"), (F.max, "hi_"))]
    again = [f(f"{n}{c}").alias(f"{n}{c}") for c in ("l", *(f"_{k}{i}" for i in range(len(categories)) for k in ("raw", "norm"))) for f, n in ((F.min, "lo_"), (F.max, "hi_"))]
    several = F.col("lo_l") != F.col("hi_l")
    records = rows.groupBy("i", "e", "r").agg(F.count(F.lit(1)).alias("n"), *ends).withColumn("by_record", several.cast("int"))
    events = records.groupBy("i", "e").agg(F.sum("n").alias("n"), F.max("by_record").alias("by_record"), *again).withColumn("by_event", several.cast("int"))
    groups = events.groupBy("i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("events"), F.max("by_record").alias("by_record"), F.max("by_event").alias("by_event"), *again).where(several)
    collapsed = F.lit(False)
    for i in range(len(categories)):
        collapsed = collapsed | ((F.col(f"lo__raw{i}") != F.col(f"hi__raw{i}")) & (F.col(f"lo__norm{i}") == F.col(f"hi__norm{i}")))
    return groups.agg(
        F.count(F.lit(1)).alias("conflicting_identities"), F.coalesce(F.sum("n"), F.lit(0)).alias("affected_rows"), F.count_if(F.col("by_record") == 1).alias("record_conflicts"),
        F.count_if(F.col("by_event") == 1).alias("event_conflicts"), F.count_if(F.col("events") == 1).alias("one_event"),
        F.count_if(F.col("events") > 1).alias("projection_conflicts"), F.count_if(collapsed).alias("category_conflicts"),
    )
