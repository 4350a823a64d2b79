"""The figures that reports add to counts: totals of a classifier, moments of features, time ranges, audits with examples.

Examples are the few least of their kind, kept by rank before groups are gathered, so that no list grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators import metrics as M
from netloom.operators.labels import KNOWN
from netloom.operators.running import quantiles

# Mixed identities, and their share of the rows, from which a review is asked for.
REVIEW_IDENTITIES, REVIEW_SHARE = 5, 0.05


def report_totals(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: rows, accuracy, known_accuracy (rows of known classes), macro and weighted averages over classes with support."""
    each = M.class_report(df, truth, predicted).where("support > 0")
    macro = each.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    right, known = (F.col(truth) == F.col(predicted)).cast("double"), F.col(truth).isin(*KNOWN)
    whole = df.agg(F.count(F.lit(1)).alias("rows"), F.avg(right).alias("accuracy"), F.avg(F.when(known, right)).alias("known_accuracy"))
    return whole.crossJoin(F.broadcast(macro))  # one row and one row


def feature_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """name, n, mean, deviation, zeros (share), p01, p05, p95, p99 of each feature's values that are there."""
    values = M.long(df, features).where("x IS NOT NULL")
    basic = values.groupBy("name").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"), F.avg((F.col("x") == 0).cast("double")).alias("zeros"))
    at = {"p01": 0.01, "p05": 0.05, "p95": 0.95, "p99": 0.99}
    return quantiles(values, ["name"], "x", at).join(basic, "name").select("name", "n", "mean", "deviation", "zeros", *at)


def time_range(df: DataFrame, time: str, keys: list[str] | None = None) -> DataFrame:
    """keys, rows, timed, first, last, seconds; null where no row has a time."""
    out = df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("rows"), F.count(time).alias("timed"), F.min(time).alias("first"), F.max(time).alias("last"))
    return out.withColumn("seconds", F.col("last").cast("double") - F.col("first").cast("double"))


def _mixed(df: DataFrame) -> DataFrame:
    """identity, rows, labels (number), least, greatest label."""
    pairs = df.groupBy("identity", "label").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("identity").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("labels"))


def identity_audit(df: DataFrame) -> DataFrame:
    """One row: rows, identities, mixed_identities, mixed_rows, mixed_share, review (by the rule above)."""
    out = _mixed(df).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("identities"), F.count_if(F.col("labels") > 1).alias("mixed_identities"), F.coalesce(F.sum(F.when(F.col("labels") > 1, F.col("rows"))), F.lit(0)).alias("mixed_rows"))
    out = out.withColumn("mixed_share", S.ratio(F.col("mixed_rows"), F.col("rows")))
    return out.withColumn("review", (F.col("mixed_identities") >= REVIEW_IDENTITIES) & (F.coalesce("mixed_share", F.lit(0.0)) >= REVIEW_SHARE))


def top_identities(df: DataFrame, top: int = 10) -> DataFrame:
    """place, identity, rows, labels of the identities with most rows, ties by identity."""
    first = _mixed(df).orderBy(F.desc("rows"), "identity").limit(top)
    return first.select(F.row_number().over(Window.orderBy(F.desc("rows"), "identity")).alias("place"), "identity", "rows", "labels")


def label_pair_examples(df: DataFrame, examples: int = 3) -> DataFrame:
    """label_a, label_b, identities, rows, examples (the least identities) of labels that meet on an identity."""
    pairs = df.groupBy("identity", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy("identity").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("ls")).where(F.size("ls") > 1)  # few labels each
    left = groups.select("identity", "ls", F.posexplode("ls").alias("i", "a"))
    met = left.select("identity", "a", F.explode(F.expr("slice(ls, i + 2, size(ls))")).alias("b"))
    met = met.select("identity", F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), (F.col("a.n") + F.col("b.n")).alias("n"))
    by = ["label_a", "label_b"]
    totals = met.groupBy(*by).agg(F.count(F.lit(1)).alias("identities"), F.sum("n").alias("rows"))
    first = met.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("identity"))).where(F.col("_r") <= examples)
    return totals.join(first.groupBy(*by).agg(F.array_sort(F.collect_list("identity")).alias("examples")), by)


def ambiguity_by(df: DataFrame, source: str) -> DataFrame:
    """source, label, original, excluded, kept rows when identities with several labels go."""
    bad = _mixed(df).where("labels > 1").select("identity", F.lit(True).alias("_bad"))
    marked = df.join(bad, "identity", "left")
    return marked.groupBy(source, "label").agg(F.count(F.lit(1)).alias("original"), F.count("_bad").alias("excluded"), F.count_if(F.col("_bad").isNull()).alias("kept"))


def expected_collisions(df: DataFrame, column: str, bits: tuple[int, ...]) -> DataFrame:
    """bits, values (distinct), expected_pairs that share a bucket by chance."""
    n = df.agg(F.countDistinct(S.category_token(F.col(column))).alias("values"))
    each = n.withColumn("bits", F.explode(F.array(*map(F.lit, bits))))
    return each.select("bits", "values", (F.col("values") * (F.col("values") - 1) / 2 / F.pow(F.lit(2.0), "bits")).alias("expected_pairs"))


def scenario_cells(df: DataFrame, scenarios: str, label: str) -> DataFrame:
    """scenario, label, rows, identities, outcomes (share of rows with the most frequent outcome). df: identity, outcome."""
    each = df.select(F.explode(scenarios).alias("scenario"), F.col(label).alias("label"), "identity", "outcome")
    ids = each.groupBy("scenario", "label", "identity", "outcome").agg(F.count(F.lit(1)).alias("n"))
    outcomes = ids.groupBy("scenario", "label", "outcome").agg(F.sum("n").alias("n")).groupBy("scenario", "label").agg((F.max("n") / F.sum("n")).alias("outcomes"))
    cells = ids.groupBy("scenario", "label", "identity").agg(F.sum("n").alias("n")).groupBy("scenario", "label").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("identities"))
    return cells.join(outcomes, ["scenario", "label"])
