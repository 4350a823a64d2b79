"""Score distributions, thresholds, ranking and alert quality."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators.running import quantiles, running
from netloom.operators.staged import staged

#: Distinct scores of a bootstrap, 24 bytes each on every executor.
MOST_SCORES = 2_000_000

STATS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def long(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, name, x: one row for each value of the columns."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns)))
    return df.select(*(keys or []), pairs.alias("p")).select(*(keys or []), "p.name", "p.x")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, min, p50, p90, p95, p99, max, mean of each column, exact and linear between values."""
    values = long(df, columns).where("x IS NOT NULL")
    basic = values.groupBy("name").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))
    return quantiles(values, ["name"], "x", STATS).join(basic, "name").select("name", "n", "min", *STATS, "max", "mean")


def feature_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """name, n, missing, min, quartiles, max, constant, near_constant (a value with 99 % or more)."""
    values = long(df, features)
    top = values.where("x IS NOT NULL").groupBy("name", "x").agg(F.count(F.lit(1)).alias("c")).groupBy("name").agg(F.max("c").alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"))
    stats = values.groupBy("name").agg(F.count_if(F.col("x").isNull()).alias("missing"), F.min("x").alias("min"), F.max("x").alias("max"))
    quarters = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    joined = stats.join(top, "name", "left").join(quantiles(values, ["name"], "x", quarters).drop("n"), "name", "left")
    return joined.select("name", F.coalesce("n", F.lit(0)).alias("n"), "missing", "min", *quarters, "max", (F.col("distinct") <= 1).alias("constant"), (F.col("top") >= 0.99 * F.col("n")).alias("near_constant"))


def calibrated(df: DataFrame, scores: list[str], normal: F.Column, fpr: float = 0.01) -> DataFrame:
    """name, threshold: the (1 - fpr) quantile of each score over normal rows."""
    return quantiles(long(df.where(normal), scores), ["name"], "x", {"threshold": 1.0 - fpr}).select("name", "threshold", "n")


def upper_quantile(df: DataFrame, score: str, q: float = 0.99) -> DataFrame:
    """threshold: the least value with at least the share q of the others at or below it (never between values)."""
    counts = df.groupBy(F.col(score).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    run = running(counts, [], "x", ["c"])
    return run.where(F.col("upto_c") >= F.ceil((F.col("all_c") - 1) * q) + 1).agg(F.min("x").alias("threshold"))


def identity_means(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("rows"))


def ranking(df: DataFrame, score: str, positive: F.Column, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """keys, positives, negatives, auroc, average_precision: by counts at distinct scores, ties shared. A row stands for `weight` rows."""
    keys = keys or []
    number = lambda cond: F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0)) if weight else F.count_if(cond)
    at = df.groupBy(*keys, (-F.col(score)).alias("x")).agg(number(positive).alias("p"), number(~positive).alias("n"))
    run = running(at, keys, "x", ["p", "n"]).withColumnsRenamed({"upto_p": "tp", "upto_n": "fp"})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") / 2.0)
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = run.groupBy(*keys).agg(F.max("all_p").alias("positives"), F.max("all_n").alias("negatives"), area.alias("area"), ap.alias("ap"))
    c = F.col
    return out.select(*keys, "positives", "negatives", S.ratio(c("area"), c("positives") * c("negatives")).alias("auroc"), S.ratio(c("ap"), c("positives")).alias("average_precision"))


def alert_rates(df: DataFrame, score: str, positive: F.Column, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """keys, tp, fp, tn, fn, tpr, fpr, specificity, precision, f1, balanced_accuracy; an alert is a score over the threshold."""
    alert, c = F.col(score) > threshold, F.col
    out = df.groupBy(*(keys or [])).agg(F.count_if(positive & alert).alias("tp"), F.count_if(~positive & alert).alias("fp"), F.count_if(~positive & ~alert).alias("tn"), F.count_if(positive & ~alert).alias("fn"))
    zero = lambda a, b: F.coalesce(S.ratio(a, b), F.lit(0.0))
    out = out.withColumn("tpr", zero(c("tp"), c("tp") + c("fn"))).withColumn("fpr", zero(c("fp"), c("fp") + c("tn"))).withColumn("precision", zero(c("tp"), c("tp") + c("fp")))
    return out.withColumn("specificity", 1 - c("fpr")).withColumn("f1", zero(2 * c("precision") * c("tpr"), c("precision") + c("tpr"))).withColumn("balanced_accuracy", (c("tpr") + 1 - c("fpr")) / 2)


def operating_point(df: DataFrame, score: str, positive: F.Column, budget: float) -> DataFrame:
    """threshold, tpr, fpr: the highest TPR with an FPR within the budget, of equals the one nearest to it."""
    at = df.groupBy((-F.col(score)).alias("x")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    run = running(at, [], "x", ["p", "n"]).select((-F.col("x")).alias("threshold"), (F.col("upto_p") / F.col("all_p")).alias("tpr"), (F.col("upto_n") / F.col("all_n")).alias("fpr"))
    return run.where(F.col("fpr") <= budget).orderBy(F.desc("tpr"), F.desc("fpr"), F.desc("threshold")).limit(1)


def confusions(df: DataFrame, truth: str, predicted: str, top: int = 10) -> DataFrame:
    """The most frequent mistakes: truth, predicted, n, share of the true class."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    share = cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))
    return share.where(F.col(truth) != F.col(predicted)).orderBy(F.desc("n"), F.desc("share"), truth, predicted).limit(top)


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of each class, from the confusion counts."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"))))
    hits = cells.where(F.col(truth) == F.col(predicted)).select(F.col(truth).alias("label"), F.col("n").alias("hit"))
    sums = cells.select(sides.alias("s")).groupBy("s.label").agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("guessed")).join(hits, "label", "left")
    hit = F.coalesce("hit", F.lit(0))
    zero = lambda a, b: F.coalesce(S.ratio(a, b), F.lit(0.0))
    out = sums.select("label", "support", zero(hit, F.col("guessed")).alias("precision"), zero(hit, F.col("support")).alias("recall"))
    return out.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_summary(df: DataFrame) -> DataFrame:
    """One row of counts and rates over scored rows: is_zeroday, classifier_class, predicted_class, label."""
    truth = S.truth_verdict(F.col("label"))
    normal, attack = truth == "Normal", truth == "Known-Attack"
    ood, classifier = F.col("is_zeroday"), F.lower(F.trim("classifier_class")) != "normal"
    alert = F.col("predicted_class").isin("Known-Attack", "Zero-Day Candidate")
    rate = lambda cond, of: F.round(F.avg(F.when(of, cond.cast("double"))), 6)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ood).alias("zero_day_count"), rate(ood, F.lit(True)).alias("zero_day_rate"),
        F.count_if(normal).alias("normal_count"), rate(ood, normal).alias("normal_ood_fpr"), rate(ood | classifier, normal).alias("normal_alert_fpr"),
        rate(classifier, normal).alias("known_classifier_fpr"), rate(ood & classifier, normal).alias("normal_overlap_rate"),
        F.count_if(attack).alias("attack_count"), rate(alert, attack).alias("attack_detection_rate"), rate(alert == attack, normal | attack).alias("detection_accuracy"),
        F.count_if(normal & ((ood | classifier) != alert)).alias("inconsistent_rows"),
    )


def across_seeds(cells: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, name, mean, sample_sd, min, max over the seeds."""
    return long(cells, metrics, keys).groupBy(*keys, "name").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sample_sd"), F.min("x").alias("min"), F.max("x").alias("max"))


def bootstrap(df: DataFrame, score: str, positive: F.Column, replicates: int = 2000, seed: int = 7, threshold: float = 0.5, least_valid: int = 1) -> DataFrame:
    """name, lo, hi, valid, discarded: 95 % intervals of AUROC, AP, TPR and FPR over stratified resamples.

    Each replicate draws as many positives and as many negatives as there are, with replacement, by md5 of
    (seed, stratum, replicate, draw): strata keep their sizes. What goes to the executors are the counts at distinct
    scores, at most MOST_SCORES (more raise; round the scores then); a task counts a replicate's draws at them and has
    all four metrics by one pass from the highest score down. A score over the threshold is an alert. Null scores take
    no part; a replicate without a finite value of every metric is discarded, and fewer than least_valid raise.
    """
    spark = df.sparkSession
    scored = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("x")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    held = scored.orderBy("x").limit(MOST_SCORES + 1).toPandas()
    if len(held) > MOST_SCORES:
        raise ValueError(f"more than {MOST_SCORES} distinct scores")
    totals = int(held.p.sum()), int(held.n.sum())
    if not all(totals) or replicates < max(1, least_valid):
        raise ValueError(f"no bootstrap of {totals[0]} positives and {totals[1]} negatives with {replicates} replicates")
    shared = spark.sparkContext.broadcast((held.x.to_numpy(), held.p.cumsum().to_numpy(), held.n.cumsum().to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, *upto = shared.value
        over = x > threshold
        for batch in batches:
            out = []
            for r in batch.column(0).to_pylist():
                p, n = (_resampled(seed, name, r, c) for name, c in zip("pn", upto, strict=True))
                tp, fp = np.cumsum(p[::-1]), np.cumsum(n[::-1])
                p, n, here = p[::-1], n[::-1], (p + n)[::-1] > 0
                ap = float((p[here] * tp[here] / (tp[here] + fp[here])).sum()) / tp[-1]
                out.append((r, float((n * (tp - p) + n * p / 2).sum()) / (float(tp[-1]) * float(fp[-1])), ap, float(p[::-1][over].sum()) / tp[-1], float(n[::-1][over].sum()) / fp[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["r", "auroc", "average_precision", "tpr", "fpr"])

    parts = min(replicates, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = spark.range(1, replicates + 1, 1, parts).mapInArrow(run, "r long, auroc double, average_precision double, tpr double, fpr double")
    names = ["auroc", "average_precision", "tpr", "fpr"]
    good = F.forall(F.array(*names), lambda v: ~F.isnan(v))
    each = each.withColumn("good", good)
    ends = [F.percentile(F.when(F.col("good"), F.col(n)), F.lit(q)).alias(f"{n}_{side}") for n in names for side, q in (("lo", 0.025), ("hi", 0.975))]
    valid = F.count_if("good")
    few = F.when(valid < least_valid, F.raise_error(F.lit("too few valid replicates")).cast("long")).otherwise(valid)
    row = each.agg(few.alias("valid"), F.count_if(~F.col("good")).alias("discarded"), *ends)
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi")) for n in names))).alias("m"), "valid", "discarded").select("m.*", "valid", "discarded")


def _resampled(seed: int, stratum: str, replicate: int, upto: np.ndarray) -> np.ndarray:
    """How often each distinct score is drawn; upto counts the stratum's members up to each score."""
    total, counts = int(upto[-1]), np.zeros(len(upto), np.int64)
    for at in range(0, total, 1 << 20):
        draws = range(at, min(total, at + (1 << 20)))
        u = np.fromiter((int(hashlib.md5(f"{seed}|{stratum}|{replicate}|{j}".encode()).hexdigest()[:13], 16) for j in draws), np.int64, len(draws))
        member = np.floor(u / float(1 << 52) * total).astype(np.int64)
        counts += np.bincount(np.searchsorted(upto, member, side="right"), minlength=len(upto))
    return counts


def fused(a: F.Column, b: F.Column, c: F.Column) -> F.Column:
    """a * b + c of doubles, rounded once: the product's and the sum's rounding errors are added back."""
    upper = lambda v: v * 134_217_729.0 - (v * 134_217_729.0 - v)
    p, ah, bh = a * b, upper(a), upper(b)
    al, bl = a - ah, b - bh
    s = p + c
    rest = (p - (s - (s - p))) + (c - (s - p)) + (((ah * bh - p) + ah * bl + al * bh) + al * bl)
    return F.when(F.isnan(rest), s).otherwise(s + rest)  # not finite, or so large that its upper half is not


def adaptive_threshold(df: DataFrame, seq: str, score: str, by: str, window: int = 100, fpr: float = 0.05) -> DataFrame:
    """df with threshold (quantile of the `window` scores before the row; infinite before the first) and alert.

    Each stream `by` is ordered on its own, so streams run in parallel. The quantile is low * (1 - part) + high * part
    with the first product unrounded, as quantile_cont in DuckDB: a score that equals it must not alert by a last bit.
    """
    before = Window.partitionBy(by).orderBy(seq).rowsBetween(-window, -1)
    place = F.greatest(F.size("_before") - 1, F.lit(0)) * F.lit(1.0 - fpr)
    out = df.withColumn("_before", F.array_sort(F.collect_list(F.col(score).cast("double")).over(before))).withColumn("_place", place)
    at = lambda k: F.try_element_at("_before", k.cast("int") + 1)
    out = out.withColumns({"_low": at(F.floor("_place")), "_high": at(F.ceil("_place")), "_part": F.col("_place") - F.floor("_place")})
    threshold = F.when(F.size("_before") > 0, fused(F.col("_low"), 1 - F.col("_part"), F.col("_high") * F.col("_part"))).otherwise(F.lit(float("inf")))
    out = out.withColumn("threshold", threshold).withColumn("alert", F.col(score) > F.col("threshold"))
    return out.drop("_before", "_place", "_low", "_high", "_part")


def drift(reference: DataFrame, current: DataFrame, p95_ratio: float = 1.5) -> DataFrame:
    """name, stat, reference, current, delta, ratio, warn of two distribution() results."""
    stats = ["mean", "p50", "p90", "p95", "p99"]
    side = lambda d, n: d.select("name", F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias(n)) for s in stats))).alias("s")).select("name", "s.stat", f"s.{n}")
    joined = side(reference, "reference").join(side(current, "current"), ["name", "stat"])
    ratio = F.when(F.abs("reference") >= 1e-12, F.col("current") / F.col("reference"))
    out = joined.withColumn("delta", F.col("current") - F.col("reference")).withColumn("ratio", ratio)
    return out.withColumn("warn", F.coalesce((F.col("stat") == "p95") & (F.col("ratio") > p95_ratio), F.lit(False)))


def compare_columns(df: DataFrame, pairs: list[tuple[str, str]], tolerance: float) -> DataFrame:
    """name, n, exact, within, null_mismatch, sign_mismatch, mean_error, max_error, p95_error of column pairs of aligned rows."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("name"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for a, b in pairs)))
    v = df.select(each.alias("v")).select("v.*").withColumn("e", F.abs(F.col("a") - F.col("b")))
    both = F.col("e").isNotNull()
    out = v.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("exact"), F.count_if(both & (F.col("e") <= tolerance)).alias("within"),
        F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("null_mismatch"), F.count_if(both & (F.signum("a") != F.signum("b"))).alias("sign_mismatch"),
        F.avg("e").alias("mean_error"), F.max("e").alias("max_error"),
    )
    return out.join(quantiles(v, ["name"], "e", {"p95_error": 0.95}).drop("n"), "name", "left")


def compared_methods(df: DataFrame, target_fpr: float) -> DataFrame:
    """method, auroc, auprc, alert_rate, normal_fpr, attack_detection_rate of df (method, v, attack).

    A method's threshold is the (1 - target_fpr) quantile of its values on rows that are no attack; alerts lie over it.
    """
    attack = F.col("attack")
    df = staged(df.groupBy("method", "v", "attack").agg(F.count(F.lit(1)).alias("_w")))  # read by all that follows: values are made once
    cut = quantiles(df.where(~attack), ["method"], "v", {"cut": 1 - target_fpr}, "_w").select("method", "cut")
    over = F.col("v") > F.col("cut") + 1e-9  # a quantile between equal values may round up
    share = lambda of: F.sum(F.when(of & over.isNotNull(), over.cast("long") * F.col("_w"))) / F.sum(F.when(of & over.isNotNull(), F.col("_w")))
    rates = df.join(F.broadcast(cut), "method").groupBy("method").agg(share(F.lit(True)).alias("alert_rate"), share(~attack).alias("normal_fpr"), share(attack).alias("attack_detection_rate"))
    return ranking(df, "v", attack, ["method"], "_w").select("method", "auroc", F.col("average_precision").alias("auprc")).join(rates, "method")
