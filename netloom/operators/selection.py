"""Choice of a scorer by development data, its threshold by known calibration data, and the run on external data.

Every evaluation cell (target, seed, ...) is a key, and all cells go through the same few aggregates at once; what is
broadcast are the class centroids of the cells (cells * classes rows) and their choices (a row a cell).

df: the cell's keys, role, label, identity, representation and logits (arrays of doubles). A score that is not finite,
or a cell without one of the two development roles, raises: no cell is chosen by what is not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators import metrics as M
from netloom.operators.running import running

# The scorers, the tolerance of a tie and who wins it, the quantile of known scores.
SCORERS = ("negative_max_softmax", "nearest_centroid_l2")
TIE, PREFERRED, QUANTILE = 1e-12, "nearest_centroid_l2", 0.99


def centroids(df: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """keys, centroids: the mean representation of each class of the train role."""
    mean = F.array(*(F.avg(F.col("representation")[i]) for i in range(dims)))
    each = df.where("role = 'train'").groupBy(*keys, "label").agg(mean.alias("c"))
    return each.groupBy(*keys).agg(F.collect_list("c").alias("centroids"))


def with_scores(df: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """df with a column for each scorer, higher for rows that look less like known ones."""
    distance = lambda c: F.sqrt(F.aggregate(F.zip_with("representation", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    out = df.join(F.broadcast(centroids(df, keys, dims)), keys)
    softmax = -F.array_max(S.softmax(F.col("logits")))
    near = F.array_min(F.transform("centroids", distance))
    return out.withColumn("negative_max_softmax", S.require_finite(softmax, "softmax")).withColumn("nearest_centroid_l2", S.require_finite(near, "distance")).drop("centroids")


def development(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, scorer, known_identities, surrogate_identities, auroc: by means of identities."""
    rows = scored.where(F.col("role").isin("meta_known", "surrogate_ood"))
    each = rows.select(*keys, "role", "identity", F.explode(F.array(*(F.struct(F.lit(s).alias("scorer"), F.col(s).alias("v")) for s in SCORERS))).alias("s")).select(*keys, "role", "identity", "s.*")
    means = M.identity_means(each, [*keys, "scorer", "role", "identity"], "v")
    out = M.ranking(means, "v", F.col("role") == "surrogate_ood", [*keys, "scorer"])
    return out.select(*keys, "scorer", F.col("negatives").alias("known_identities"), F.col("positives").alias("surrogate_identities"), "auroc")


def chosen(statistics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, selected, margin (centroid less softmax), tie. A statistic that is missing raises."""
    of = lambda s: F.max(F.when(F.col("scorer") == s, F.col("auroc")))
    both = statistics.groupBy(*keys).agg(of(SCORERS[1]).alias("c"), of(SCORERS[0]).alias("s"))
    margin = F.when(F.col("c").isNull() | F.col("s").isNull(), F.raise_error(F.lit("no finite selection statistic")).cast("double")).otherwise(F.col("c") - F.col("s"))
    out = both.select(*keys, margin.alias("margin")).withColumn("tie", F.abs("margin") <= TIE)
    return out.withColumn("selected", F.when(F.col("tie") & F.lit(PREFERRED == SCORERS[1]) | (F.col("margin") > 0), SCORERS[1]).otherwise(SCORERS[0]))


def selected_score(choice: Column) -> Column:
    return F.when(choice == SCORERS[0], F.col(SCORERS[0])).when(choice == SCORERS[1], F.col(SCORERS[1]))


def thresholds(scored: DataFrame, choice: DataFrame, keys: list[str], q: float = QUANTILE) -> DataFrame:
    """keys, selected, threshold, calibration_rows: the least calibration score with a share of at least q up to it."""
    rows = scored.where("role = 'calibration'").join(F.broadcast(choice.select(*keys, "selected")), keys)
    counts = rows.groupBy(*keys, "selected", selected_score(F.col("selected")).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    run = running(counts, [*keys, "selected"], "x", ["c"])
    out = run.where(F.col("upto_c") >= F.ceil((F.col("all_c") - 1) * q) + 1)
    return out.groupBy(*keys, "selected").agg(F.min("x").alias("threshold"), F.max("all_c").alias("calibration_rows"))


def external_run(scored: DataFrame, frozen: DataFrame, keys: list[str], positive: Column) -> DataFrame:
    """keys, selected, threshold, rows, tp, fp, tn, fn, tpr, fpr, auroc of external rows under the frozen choice.

    Rows are scored by the chosen scorer only and are an alert over the frozen threshold; nothing is fitted here.
    """
    rows = scored.where("role = 'external'").join(F.broadcast(frozen.select(*keys, "selected", "threshold")), keys)
    rows = rows.withColumn("v", selected_score(F.col("selected"))).withColumn("_p", positive)
    alert, p = F.col("v") > F.col("threshold"), F.col("_p")
    counts = rows.groupBy(*keys, "selected", "threshold").agg(F.count(F.lit(1)).alias("rows"), F.count_if(p & alert).alias("tp"), F.count_if(~p & alert).alias("fp"), F.count_if(~p & ~alert).alias("tn"), F.count_if(p & ~alert).alias("fn"))
    quality = M.ranking(rows, "v", p, keys).select(*keys, "auroc")
    out = counts.join(quality, keys)
    return out.withColumn("tpr", S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("fpr", S.ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def require_transformed(df: DataFrame, encoded: list[str], centre: dict[str, float], scale: dict[str, float]) -> DataFrame:
    """df with scaled_<f> (double) and single_<f> (single precision) of each encoded feature; nothing is filled or cut.

    A value that is not finite raises, and so does one that leaves single precision.
    """
    out = df
    for f in encoded:
        scaled = (S.require_finite(F.col(f), f) - centre[f]) / (scale[f] or 1.0)
        out = out.withColumn(f"scaled_{f}", S.require_finite(scaled, f)).withColumn(f"single_{f}", S.require_finite(F.col(f"scaled_{f}").cast("float"), f"{f} in single precision").cast("float"))
    return out
