"""Target-isolated folds and their checks, support of families, unseen-category collisions, evaluation cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators import identity as I
from netloom.operators.labels import HELD_OUT, KNOWN

# Distinct identities from which a family's support is high, medium or low.
TIERS = (("high", 1000), ("medium", 200), ("low", 50))


def isolated_fold(df: DataFrame, target: str, seed: int = 42) -> DataFrame:
    """df (identity, label) with roles for a held-out target: its identities leave every other role, known families
    are split by groups, the other held-out families are the surrogate without identities that known ones have."""
    wanted = df.where(F.col("label") == target)
    rest = I.purged(df.where(F.col("label") != target), wanted).drop("role")
    known = rest.where(F.col("label").isin(*KNOWN))
    surrogate = I.purged(rest.where(F.col("label").isin(*HELD_OUT)), known).withColumn("role", F.lit("surrogate_ood"))
    parts = I.grouped_split(known, seed).unionByName(surrogate)
    return parts.unionByName(wanted.drop("role").withColumn("role", F.lit("target")))


def leaks(fold: DataFrame) -> DataFrame:
    """identity, roles of identities in several roles, and of labels in a role they may not be in."""
    several = fold.groupBy("identity").agg(F.array_sort(F.collect_set("role")).alias("roles")).where(F.size("roles") > 1)
    wrong = fold.where(F.col("label").isin(*HELD_OUT) & ~F.col("role").isin("surrogate_ood", "target"))
    return several.union(wrong.select("identity", F.array("role")))


def require_isolated(fold: DataFrame) -> DataFrame:
    """The fold, if no identity stands in two roles and no label where it may not be; raises else."""
    found = leaks(fold).limit(5).collect()
    if found:
        raise ValueError(f"the fold leaks: {[(r.identity, list(r.roles)) for r in found]}")
    return fold


def support_tiers(df: DataFrame) -> DataFrame:
    """label, identities, tier, surrogate (the two families with most identities)."""
    counts = df.where(F.col("label").isin(*HELD_OUT)).groupBy("label").agg(F.countDistinct("identity").alias("identities"))
    tier = F.lit("insufficient")
    for name, least in reversed(TIERS):
        tier = F.when(F.col("identities") >= least, name).otherwise(tier)
    rank = F.row_number().over(Window.orderBy(F.desc("identities"), "label"))  # as many rows as there are families
    return counts.select("label", "identities", tier.alias("tier"), (rank <= 2).alias("surrogate"))


def bucket_collisions(df: DataFrame, column: str, bits: tuple[int, ...], version: str = "category-v1") -> DataFrame:
    """bits, colliding_buckets, colliding_pairs of the column's distinct categories hashed into 2**bits buckets."""
    tokens = df.select(S.category_token(F.col(column)).alias("t")).distinct()
    digest = F.sha2(F.concat(F.lit(f'["{version}","{column}","'), F.col("t"), F.lit('"]')), 256)
    low = F.conv(F.substring(digest, 57, 8), 16, 10).cast("long")
    each = tokens.select(low.alias("h"), F.explode(F.array(*map(F.lit, bits))).alias("bits"))
    cells = each.groupBy("bits", F.expr("h % shiftleft(1L, bits)").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("bits").agg(F.count_if(F.col("n") > 1).alias("colliding_buckets"), F.sum(F.expr("n * (n - 1) div 2")).alias("colliding_pairs"))


def family_recall(decided: DataFrame) -> DataFrame:
    """family, support, detected, recall. decided: family, classifier_class, is_zeroday."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return decided.groupBy("family").agg(F.count(F.lit(1)).alias("support"), share(F.col("is_zeroday")).alias("detected"), share(F.col("classifier_class") == F.col("family")).alias("recall"))


def cells(df: DataFrame, seeds: tuple[int, ...], surfaces: tuple[str, ...]) -> DataFrame:
    """target, seed, surface of every evaluation cell."""
    targets = df.where(F.col("label").isin(*HELD_OUT)).select(F.col("label").alias("target")).distinct()
    return targets.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("surface", F.explode(F.array(*map(F.lit, surfaces))))


def scenario_groups(df: DataFrame, scenarios: str, source: str, protocol: str) -> DataFrame:
    """scenario, n, sources, protocols: rows fan out to the scenarios they belong to."""
    each = df.select(F.explode(scenarios).alias("scenario"), source, protocol)
    names = F.array_join(F.array_sort(F.collect_set(F.col(protocol).cast("string"))), ",")
    return each.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("sources"), names.alias("protocols"))
