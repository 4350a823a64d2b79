"""Content identities, label conflicts, leakage between roles, purges, grouped splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators.labels import HELD_OUT, KNOWN
from netloom.operators.running import positions

ROLES = ("train", "val", "meta_known", "calibration")  # in order of priority


def _features(df: DataFrame, names: list[str]) -> None:
    """Labels and metadata (names that start with __) are no features, and all have to be there."""
    wrong = [c for c in names if c.startswith("__") or c in ("label", "attack_cat", "label_binary")]
    missing = [c for c in names if c not in df.columns]
    if wrong or missing or not names:
        raise ValueError(f"not usable as features: {wrong}; missing: {missing}; {len(names)} columns")


def with_identity(df: DataFrame, numbers: list[str], texts: list[str], name: str = "identity") -> DataFrame:
    """A fingerprint of the named columns as the preprocessing sees them: single precision, texts as they stand."""
    _features(df, [*numbers, *texts])
    return df.withColumn(name, S.fingerprint(*(("float", F.col(c)) for c in numbers), *(("text", F.col(c)) for c in texts)))


def with_canonical_identity(df: DataFrame, numbers: list[str], texts: list[str], name: str = "identity") -> DataFrame:
    """A fingerprint in single precision with compatibility-normalised, case-folded categories."""
    _features(df, [*numbers, *texts])
    return df.withColumn(name, S.fingerprint(*(("float", F.col(c)) for c in numbers), *(("text", S.full_category_token(F.col(c))) for c in texts)))


def with_input_identity(df: DataFrame, matrix: list[str], name: str = "identity") -> DataFrame:
    """A fingerprint of the single-precision vector that a model is given; a value that is not finite raises."""
    _features(df, matrix)
    return df.withColumn(name, S.fingerprint(*(("float", S.require_finite(F.col(c), c)) for c in matrix)))


def _share(seed: int, row: str, *more: str) -> F.Column:
    """A number in [0, 1) from a hash of the row, the same on every engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row).cast("string"), *more))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)


def reference_share(df: DataFrame, row: str, share: float) -> DataFrame:
    """reference: whether a row is among the first round(rows * share), one at least and not all, by row number; a
    single row is reference and evaluation both. The row numbers tell rows apart."""
    placed = positions(df, [F.col(row).asc()], "_place")
    n = placed.count()
    first = max(1, min(n - 1, round(n * share))) if n > 1 else n
    return placed.withColumn("reference", F.col("_place") < first).withColumn("evaluated", (F.col("_place") >= first) | F.lit(n == 1)).drop("_place")


def row_split(df: DataFrame, seed: int, row: str = "row_id") -> DataFrame:
    """role: train, val, meta_known or calibration, 70:10:10:10 within each label, row by row: what a split by identity is compared with."""
    u = _share(seed, row, "label")
    return df.withColumn("role", F.when(u < 0.7, "train").when(u < 0.8, "val").when(u < 0.9, "meta_known").otherwise("calibration"))


def role_intersections(df: DataFrame) -> DataFrame:
    """left_role, right_role, shared: identities in both of two roles, for the pairs that share any."""
    return role_overlaps(df).select("left_role", "right_role", "shared")


def stratified_split(df: DataFrame, seed: int, parts: dict[str, float], row: str = "row_id") -> DataFrame:
    """role by random shares within each label. The shares sum to 1."""
    if abs(sum(parts.values()) - 1) > 1e-9:
        raise ValueError("the shares of a split sum to 1")
    u, upto, role = _share(seed, row, "label"), 0.0, None
    for name, share in parts.items():
        upto += share
        role = F.when(u < upto, name) if role is None else role.when(u < upto, name)
    return df.withColumn("role", role.otherwise(list(parts)[-1]))


def shares_of(counts: dict[str, int], size: int) -> dict[str, int]:
    """`size` rows shared out to classes by their counts: whole shares, then one each to the largest remainders."""
    total = sum(counts.values())
    whole = {c: n * size // total for c, n in counts.items()}
    left = size - sum(whole.values())
    for c in sorted(counts, key=lambda c: (-(counts[c] * size % total), c))[:left]:
        whole[c] += 1
    return whole


def exact_split(df: DataFrame, seed: int, parts: dict[str, float], row: str = "row_id", least: int = 5) -> DataFrame:
    """role: random parts of exact sizes. The last part has its share of all rows, rounded up, the one before its share
    of what is left, and so on; each takes of every label what its count asks for. If a label has fewer than `least`
    rows, labels are not looked at. The shares sum to 1; row numbers tell rows apart.

    Places in a label come from ranges over all labels by a digest; only counts of labels come to the driver.
    """
    if abs(sum(parts.values()) - 1) > 1e-9:
        raise ValueError("the shares of a split sum to 1")
    counts = {r.label: r["count"] for r in df.groupBy(F.coalesce("label", F.lit("")).alias("label")).count().collect()}
    whole = bool(counts) and min(counts.values()) < least
    if whole:
        counts = {"": sum(counts.values())}
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row).cast("string")))
    stratum = F.lit("") if whole else F.coalesce("label", F.lit(""))
    placed = positions(df.withColumn("_stratum", stratum).withColumn("_h", digest), [F.col("_stratum"), F.col("_h"), F.col(row)], "_place")
    left, names, ends, before = dict(counts), list(parts), [], 0
    taken: dict[str, dict[str, int]] = {}
    for i in range(len(names) - 1, 0, -1):
        share = parts[names[i]] / sum(parts[n] for n in names[: i + 1])
        taken[names[i]] = shares_of(left, math.ceil(sum(left.values()) * share - 1e-9)) if left else {}
        left = {c: n - taken[names[i]][c] for c, n in left.items()}
    taken[names[0]] = left
    for c in sorted(counts):
        upto = before
        for name in names:
            ends.append((c, name, upto, upto + taken[name][c]))
            upto += taken[name][c]
        before += counts[c]
    table = df.sparkSession.createDataFrame(ends, "_stratum string, role string, _from long, _to long")
    inside = (placed["_stratum"] == table["_stratum"]) & (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))
    out = placed.drop("role").join(F.broadcast(table), inside)  # as many rows as labels and parts
    return out.select(*(c for c in df.columns if c != "role"), "role")


def taxonomy(df: DataFrame) -> DataFrame:
    """role, same_label_identities, duplicate_rows, cross_label_identities, cross_label_rows. df: role, identity, label."""
    pairs = df.groupBy("role", "identity", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy("role", "identity").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("extra"), F.max("n").alias("most"), F.count(F.lit(1)).alias("labels"))
    return groups.groupBy("role").agg(
        F.count_if(F.col("most") > 1).alias("same_label_identities"), F.sum("extra").alias("duplicate_rows"),
        F.count_if(F.col("labels") > 1).alias("cross_label_identities"), F.sum(F.when(F.col("labels") > 1, F.col("rows")).otherwise(0)).alias("cross_label_rows"),
    )


def role_overlaps(df: DataFrame) -> DataFrame:
    """left_role, right_role, shared, same_label, cross_label identities of each pair of roles that share any."""
    sets = df.groupBy("identity", "role").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # few labels each
    roles = sets.groupBy("identity").agg(F.array_sort(F.collect_list(F.struct("role", "labels"))).alias("r")).where(F.size("r") > 1)
    left = roles.select("r", F.posexplode("r").alias("i", "a"))
    pairs = left.select("a", F.explode(F.expr("slice(r, i + 2, size(r))")).alias("b"))
    same = F.arrays_overlap("a.labels", "b.labels")
    cross = F.size(F.array_union("a.labels", "b.labels")) > 1
    return pairs.groupBy(F.col("a.role").alias("left_role"), F.col("b.role").alias("right_role")).agg(
        F.count(F.lit(1)).alias("shared"), F.count_if(same).alias("same_label"), F.count_if(cross).alias("cross_label")
    )


def gate(tax: DataFrame, overlaps: DataFrame) -> DataFrame:
    """severity, reason, place, identities: why a data set fails."""
    rows = tax.where("cross_label_identities > 0").select(F.lit("CRITICAL FAIL").alias("severity"), F.lit("same_role_cross_label").alias("reason"), F.col("role").alias("place"), F.col("cross_label_identities").alias("identities"))
    place = F.concat_ws("__", "left_role", "right_role")
    cross = overlaps.where("cross_label > 0").select(F.lit("CRITICAL FAIL"), F.lit("cross_role_cross_label"), place, "cross_label")
    same = overlaps.where("same_label > 0").select(F.lit("FAIL"), F.lit("cross_role_same_label"), place, "same_label")
    return rows.union(cross).union(same)


def ambiguous(df: DataFrame) -> DataFrame:
    """identity, rows, labels of identities with several labels."""
    groups = df.groupBy("identity").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("label")).alias("labels"))
    return groups.where(F.size("labels") > 1)


def without_ambiguous(df: DataFrame) -> DataFrame:
    """df without the rows of ambiguous identities, whole groups at a time."""
    return df.join(ambiguous(df).select("identity"), "identity", "left_anti")


def ambiguity_impact(df: DataFrame) -> DataFrame:
    """label, original, excluded, kept rows and kept identities of each family when ambiguous groups go."""
    marked = df.join(ambiguous(df).select("identity", F.lit(True).alias("bad")), "identity", "left")
    good = F.col("bad").isNull()
    return marked.groupBy("label").agg(
        F.count(F.lit(1)).alias("original"), F.count_if(~good).alias("excluded"), F.count_if(good).alias("kept"), F.countDistinct(F.when(good, F.col("identity"))).alias("kept_identities")
    )


def label_pairs(df: DataFrame) -> DataFrame:
    """label_a, label_b, identities, known_held_out: which labels meet on one identity."""
    groups = ambiguous(df)
    left = groups.select("labels", F.posexplode("labels").alias("i", "label_a"))
    pairs = left.select("label_a", F.explode(F.expr("slice(labels, i + 2, size(labels))")).alias("label_b"))
    mixed = F.col("label_a").isin(*KNOWN) != F.col("label_b").isin(*KNOWN)
    return pairs.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("identities"), F.max(mixed.cast("int")).alias("known_held_out"))


def group_classes(df: DataFrame) -> DataFrame:
    """target, class, groups, rows: overlapping classes of identities for each held-out family."""
    sets = df.groupBy("identity").agg(F.count(F.lit(1)).alias("rows"), F.collect_set("label").alias("labels"))
    known, held = (F.arrays_overlap("labels", F.array(*map(F.lit, names))) for names in (KNOWN, HELD_OUT))
    has = F.array_contains("labels", F.col("target"))
    flags = {
        "unambiguous_same_label": F.size("labels") == 1, "conflicting_labels": F.size("labels") > 1, "target_family_containing": has,
        "known_family_only": F.size(F.array_except("labels", F.array(*map(F.lit, KNOWN)))) == 0, "mixed_known_ood": known & held, "mixed_known_target": known & has,
    }
    each = sets.select("rows", "labels", F.explode(F.array(*map(F.lit, HELD_OUT))).alias("target"))
    long = each.select("target", "rows", F.explode(F.array(*(F.struct(F.lit(n).alias("class"), f.alias("is")) for n, f in flags.items()))).alias("f"))
    return long.groupBy("target", F.col("f.class").alias("class")).agg(F.count_if("f.is").alias("groups"), F.sum(F.when(F.col("f.is"), F.col("rows")).otherwise(0)).alias("rows"))


def stage_merges(df: DataFrame, before: str, after: str) -> DataFrame:
    """Identities after a stage that merge several of before it: after, upstream, rows."""
    groups = df.groupBy(after).agg(F.countDistinct(before).alias("upstream"), F.count(F.lit(1)).alias("rows"))
    return groups.where("upstream > 1")


def purged(df: DataFrame, target: DataFrame) -> DataFrame:
    """Rows whose identity the target does not have."""
    return df.join(target.select("identity").distinct(), "identity", "left_anti")


def purge_report(df: DataFrame, target: DataFrame) -> DataFrame:
    """role, rows, purged_rows, purged_identities."""
    marked = df.join(target.select("identity").distinct().withColumn("hit", F.lit(True)), "identity", "left")
    return marked.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("hit").isNotNull()).alias("purged_rows"), F.countDistinct(F.when(F.col("hit").isNotNull(), F.col("identity"))).alias("purged_identities"))


def by_priority(df: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """Each identity stays in its role of highest priority only."""
    rank = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    ranked = df.withColumn("_rank", rank)
    best = ranked.groupBy("identity").agg(F.min("_rank").alias("_best"))
    return ranked.join(best, "identity").where("_rank = _best").drop("_rank", "_best")


def test_surfaces(test: DataFrame, train: DataFrame) -> DataFrame:
    """test rows with their exclusive category: conflict in training, conflict in test, overlap with development, clean."""
    conflict = ambiguous(train).select("identity", F.lit(True).alias("c1"))
    internal = ambiguous(test).select("identity", F.lit(True).alias("c2"))
    development = without_ambiguous(train).select("identity").distinct().withColumn("c3", F.lit(True))
    joined = test.join(conflict, "identity", "left").join(internal, "identity", "left").join(development, "identity", "left")
    category = F.when(F.col("c1"), "TRAIN-CONFLICT-RELATED").when(F.col("c2"), "TEST-INTERNAL-AMBIGUOUS").when(F.col("c3"), "DEVELOPMENT-OVERLAP").otherwise("CLEAN")
    return joined.withColumn("test_category", category).drop("c1", "c2", "c3")


def support(classified: DataFrame) -> DataFrame:
    """label, test_category, rows, identities with totals (null means all), by one cube."""
    return classified.cube("label", "test_category").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("identity").alias("identities"))


def session_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Identities of two sessions: counts, Jaccard, and shared ones whose labels differ in kind. a, b: identity, label."""
    side = lambda df, n: df.groupBy("identity").agg(F.array_join(F.array_sort(F.collect_set("label")), "+").alias(n))
    both = side(a, "la").join(side(b, "lb"), "identity", "full_outer")
    shared = F.col("la").isNotNull() & F.col("lb").isNotNull()
    crossed = shared & (((F.col("la") == "NORMAL") & (F.col("lb") == "ATTACK")) | ((F.col("la") == "ATTACK") & (F.col("lb") == "NORMAL")))
    return both.agg(
        F.count_if(F.col("la").isNotNull()).alias("a_identities"), F.count_if(F.col("lb").isNotNull()).alias("b_identities"), F.count_if(shared).alias("shared"),
        F.count(F.lit(1)).alias("all"), F.count_if(crossed).alias("cross_label"),
    ).withColumn("jaccard", F.when(F.col("all") > 0, F.col("shared") / F.col("all")).otherwise(0.0))


def grouped_split(df: DataFrame, seed: int = 42, folds: int = 10, every_fold: bool = False) -> DataFrame:
    """role: 70/10/10/10 of the groups of each class (least label of a group); a group never falls into two roles.

    With every_fold a class with fewer groups than folds raises. Places within a class come from ranges over all classes, so that a
    class of any size is spread over the tasks.
    """
    groups = df.groupBy("identity").agg(F.min("label").alias("class"))
    groups = positions(groups.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), "identity"), 256)), [F.col("class"), F.col("_h")], "_place")
    sizes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))  # a row a class
    few = sizes.where(F.col("_n") < folds).orderBy("class").collect() if every_fold else []
    if few:
        raise ValueError(f"a grouped split needs {folds} identities a class: {', '.join(f'{r["class"]} has {r["_n"]}' for r in few)}")
    groups = groups.join(F.broadcast(sizes), "class")
    fold = (F.col("_place") - F.col("_first")) % folds
    role = F.when(fold < folds - 3, "train").when(fold == folds - 3, "val").when(fold == folds - 2, "meta_known").otherwise("calibration")
    return df.join(groups.withColumn("role", role).select("identity", "role"), "identity")


def set_digest(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, digest: SHA-256 of the sorted distinct values, whatever the order of rows.

    Values are hashed into buckets of a first byte before the whole is hashed, so that no task holds a set.
    """
    distinct = df.select(by, value).distinct().withColumn("_h", F.sha2(F.col(value).cast("string"), 256))
    parts = distinct.groupBy(by, F.substring("_h", 1, 2).alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ","), 256).alias("_p"))
    return parts.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("_b", "_p"))), ","), 256).alias("digest"))


def multiplicity(df: DataFrame) -> DataFrame:
    """multiplicity, identities: how many identities occur how often."""
    return df.groupBy("identity").agg(F.count(F.lit(1)).alias("multiplicity")).groupBy("multiplicity").agg(F.count(F.lit(1)).alias("identities"))
