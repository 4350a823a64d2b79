"""The production flow contract: 32 columns, analyst labels, overrides, time splits, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators.normalize import cleaned, first_present, normalize
from netloom.operators.running import positions

# The contract's columns and the labels analysts may give.
COLUMNS = (
    "event_time source source_file source_row flow_id src_ip dst_ip src_port dst_port protocol service state duration sbytes dbytes spkts dpkts "
    "sload dload sttl dttl sloss dloss sintpkt dintpkt tcprtt synack ackdat dataset_label attack_category analyst_label split"
).split()
ANALYST_LABELS = ("normal", "known_attack", "suspicious", "false_positive", "unknown")


def analyst_label(label) -> F.Column:
    text = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit(""))))
    return F.when(text.isin("", "nan", "none", "unknown"), "unknown").when(text.isin("0", "benign", "normal"), "normal").otherwise("known_attack")


def attack_category(label) -> F.Column:
    text = F.trim(F.coalesce(label.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin("", "nan", "none", "benign", "normal", "0"), "Normal").otherwise(text)


def clean_label(label) -> F.Column:
    text = F.translate(F.lower(F.trim(F.coalesce(label, F.lit("")))), "- ", "__")
    return F.when(text == "", "unknown").otherwise(text)


# The contract's names of normalised columns.
NORMALISED = {"src_ip": "srcip", "dst_ip": "dstip", "src_port": "sport", "dst_port": "dsport", "protocol": "proto", "service": "service", "state": "state", "duration": "dur"}


def to_contract(raw: DataFrame, row: str, source: str = "cicflowmeter", source_file: str = "") -> tuple[DataFrame, dict]:
    """Raw flow rows as the 32-column contract. `row` is the column that numbers the rows."""
    raw = cleaned(raw)
    have = [c for c in raw.columns if c != row]
    flat, report = normalize(raw, keep=raw.columns, context=[])
    mapped = report["mapped_columns"]
    carried = lambda name: F.col(f"`raw_{name}`") if name else F.lit("")
    times = [c for c in (first_present(have, ["timestamp", "time", "start_time", "ts", "@timestamp"]), mapped.get("stime")) if c]
    # the first candidate with any value that can be read
    read = flat.agg(*(F.max(S.event_time(carried(c)).isNotNull()).alias(f"c{i}") for i, c in enumerate(times))).first() if len(times) > 1 else [True]
    time = next((c for c, any_ in zip(times, read, strict=False) if any_), None)
    label = "label" if "label" in have else mapped.get("label")
    category = ("attack_cat" if "attack_cat" in have else mapped.get("attack_cat")) or label
    identity = first_present(have, ["flow_id", "flowid", "id"])
    columns = {
        "event_time": S.iso_z(S.event_time(carried(time))), "source": F.lit(source), "source_file": F.lit(source_file), "source_row": carried(row),
        "flow_id": carried(identity).cast("string"), "dataset_label": F.trim(F.coalesce(carried(label).cast("string"), F.lit(""))),
        "attack_category": attack_category(carried(category)), "analyst_label": analyst_label(carried(label)), "split": F.lit(""),
    }
    for name in COLUMNS:
        if name not in columns:
            inner = NORMALISED.get(name, name)
            empty = F.lit(0.0) if name in COLUMNS[12:28] else F.lit("")
            columns[name] = (F.col(inner) if name in COLUMNS[12:28] else F.col(inner).cast("string")) if inner in flat.columns else empty
    return flat.select(*(columns[c].alias(c) for c in COLUMNS)), report


def apply_overrides(flows: DataFrame, overrides: DataFrame, key: str, order: str) -> DataFrame:
    """Analyst labels from reviews; of several for a key the last by `order` counts. Unknown labels raise when read."""
    patch = overrides.withColumn("_label", clean_label(F.col("analyst_label")))
    patch = patch.withColumn("_label", F.when(F.col("_label").isin(*ANALYST_LABELS), F.col("_label")).otherwise(F.raise_error(F.concat(F.lit("invalid analyst_label: "), F.col("_label")))))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    has = "attack_category" in overrides.columns
    patch = patch.withColumn("_n", last).where("_n = 1").select(key, "_label", (F.col("attack_category") if has else F.lit(None).cast("string")).alias("_category"))
    joined = flows.join(patch, key, "left")
    return joined.withColumn("analyst_label", F.coalesce("_label", "analyst_label")).withColumn("attack_category", F.coalesce("_category", "attack_category")).drop("_label", "_category")


def split_by_time(flows: DataFrame, time: str, row: str, ratios: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """split: train, validation or test by time, rows without a time last, ties by row.

    Places come from ranges of the order, so that no task sorts all rows, whatever their days or missing times.
    """
    total = sum(ratios)
    if total <= 0:
        raise ValueError("split ratios must sum to a positive value")
    ranked = positions(flows, [F.col(time).asc_nulls_last(), F.col(row).asc()], "_rank")
    n = F.broadcast(ranked.agg(F.count(F.lit(1)).alias("_n")))
    train, validation = F.bround(F.col("_n") * (ratios[0] / total), 0), F.bround(F.col("_n") * ((ratios[0] + ratios[1]) / total), 0)
    split = F.when(F.col("_rank") < train, "train").when(F.col("_rank") < validation, "validation").otherwise("test")
    return ranked.crossJoin(n).withColumn("split", split).drop("_n", "_rank")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n: counts of each value of each column, missing ones as empty text; one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
