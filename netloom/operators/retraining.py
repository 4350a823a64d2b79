"""The gate before a model is trained again on an isolated fold: fifteen rules over one pass of tagged keys.

Each row of the fold gives its row id, canonical identity and model-input identity as tagged keys; a partial aggregate
collects, for each key, the roles it stands in as a bit mask. A second one counts identities by role and label. Every
rule is a condition on one of these two tables, so that all rules cost two shuffles, and the rows that break a rule
are counted, with the few least of them as evidence. A rule that no row can break on its own (a role is missing, a
class has too few groups) is checked on the small table of roles and labels.

Nulls: a row without an id or an identity breaks the rule of its kind, as nothing can be said of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.labels import HELD_OUT, KNOWN

KNOWN_ROLES = ("train", "val", "meta_known", "calibration")
FIT_ROLES = (*KNOWN_ROLES, "surrogate_ood")
ROLES = (*FIT_ROLES, "target")
#: Distinct identities that each class of a known role and the normal class of calibration must have.
LEAST_GROUPS, LEAST_NORMAL = 2, 20
RULES = (
    "target_label_absent_from_fit", "target_canonical_absent_from_fit", "target_model_input_absent_from_fit", "surrogate_target_canonical_absent", "surrogate_target_model_input_absent",
    "schema_frozen", "known_roles_row_disjoint", "known_roles_canonical_disjoint", "known_roles_model_input_disjoint", "all_fit_roles_row_disjoint", "all_fit_roles_canonical_disjoint",
    "all_fit_roles_model_input_disjoint", "official_test_excluded_from_fit", "calibration_has_no_target_equivalent_rows", "required_roles_usable",
)


def _mask(roles: tuple[str, ...]) -> int:
    return sum(1 << ROLES.index(r) for r in roles)


def _bits(mask: Column, roles: tuple[str, ...]) -> Column:
    return mask.bitwiseAND(F.lit(_mask(roles)))


def breaches(fold: DataFrame, target: str, features: list[str], schema: list[str], evidence: int = 5) -> DataFrame:
    """rule, broken (how often), evidence (at most so many texts): a row for each of the RULES, broken 0 where it holds.

    fold: row_id, label, role, source_role, canonical, model_input. features is what the fold was built with, schema the frozen list.
    """
    bit = F.lit(0)
    for i, role in enumerate(ROLES):
        bit = F.when(F.col("role") == role, 1 << i).otherwise(bit)
    rows = fold.withColumn("_bit", bit).withColumn("_fit", F.col("role").isin(*FIT_ROLES))
    named = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key"))
    tagged = rows.select("_bit", F.explode(F.array(named("row", "row_id"), named("canonical", "canonical"), named("model", "model_input"))).alias("k"))
    keys = tagged.groupBy("k.kind", "k.key").agg(F.bit_or("_bit").alias("mask"), F.count(F.lit(1)).alias("n"))
    mask, kind = F.col("mask"), F.col("kind")
    fit, known, surrogate, calibration, aim = (_bits(mask, r) for r in (FIT_ROLES, KNOWN_ROLES, ("surrogate_ood",), ("calibration",), ("target",)))
    without = F.col("key").isNull() & (fit > 0)
    meets = lambda side: (side > 0) & (aim > 0)
    shared = lambda side: (F.bit_count(side) > 1) | without
    on_keys = {
        "target_canonical_absent_from_fit": (kind == "canonical") & meets(fit),
        "target_model_input_absent_from_fit": (kind == "model") & meets(fit),
        "surrogate_target_canonical_absent": (kind == "canonical") & meets(surrogate),
        "surrogate_target_model_input_absent": (kind == "model") & meets(surrogate),
        "known_roles_row_disjoint": (kind == "row") & shared(known),
        "known_roles_canonical_disjoint": (kind == "canonical") & shared(known),
        "known_roles_model_input_disjoint": (kind == "model") & shared(known),
        "all_fit_roles_row_disjoint": (kind == "row") & shared(fit),
        "all_fit_roles_canonical_disjoint": (kind == "canonical") & shared(fit),
        "all_fit_roles_model_input_disjoint": (kind == "model") & shared(fit),
        "calibration_has_no_target_equivalent_rows": (kind != "row") & meets(calibration),
    }
    roles_of = F.array_join(F.filter(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.lit(r)) for i, r in enumerate(ROLES))), lambda v: v.isNotNull()), "+")
    shown = F.concat_ws(" ", "kind", F.coalesce("key", F.lit("null")), roles_of)
    broken_keys = _counted(keys, on_keys, shown, F.lit(1), evidence)
    # identities by role, label and source
    ids = rows.groupBy("role", "label", "source_role", "_fit", "canonical").agg(F.count(F.lit(1)).alias("n"))
    cells = ids.groupBy("role", "label", "source_role", "_fit").agg(F.sum("n").alias("n"), F.count("canonical").alias("identities"))
    on_cells = {
        "target_label_absent_from_fit": F.col("_fit") & F.coalesce(F.col("label") == target, F.lit(True)),
        "official_test_excluded_from_fit": F.col("_fit") & ~F.coalesce(F.col("source_role") == "official_train", F.lit(False)),
    }
    shown = F.concat_ws(" ", "role", F.coalesce("label", F.lit("null")), F.coalesce("source_role", F.lit("null")))
    broken_cells = _counted(cells, on_cells, shown, F.col("n"), evidence)
    usable = _usable(ids, target, evidence)
    frozen = [f for i, f in enumerate(features) if i >= len(schema) or schema[i] != f] + [f for f in schema if f not in features]
    spark = fold.sparkSession
    fixed = spark.createDataFrame([("schema_frozen", len(frozen), sorted(frozen)[:evidence])], "rule string, broken long, evidence array<string>")
    every = reduce(DataFrame.unionByName, (broken_keys, broken_cells, usable, fixed))
    all_rules = spark.createDataFrame([(i, r) for i, r in enumerate(RULES, 1)], "number int, rule string")
    none = F.array().cast("array<string>")
    return all_rules.join(F.broadcast(every), "rule", "left").select("number", "rule", F.coalesce("broken", F.lit(0)).alias("broken"), F.coalesce("evidence", none).alias("evidence"))


def _counted(df: DataFrame, rules: dict[str, Column], shown: Column, n: Column, evidence: int) -> DataFrame:
    """rule, broken, evidence of conditions on the rows of df. The least `evidence` texts of a rule are kept by rank, in groups first."""
    hit = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda v: v.isNotNull())
    found = df.select(F.explode(hit).alias("rule"), shown.alias("text"), n.alias("n"))
    totals = found.groupBy("rule").agg(F.sum("n").alias("broken"))
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy("text"))).where(F.col("_r") <= evidence)
    texts = first.groupBy("rule").agg(F.array_sort(F.collect_list("text")).alias("evidence"))
    return totals.join(texts, "rule").select("rule", F.col("broken").cast("long").alias("broken"), "evidence")


def _usable(ids: DataFrame, target: str, evidence: int) -> DataFrame:
    """required_roles_usable: every fit role has rows, known roles all known classes and no others with enough identities each."""
    groups = ids.groupBy("role", "label").agg(F.countDistinct("canonical").alias("identities"))
    spark = ids.sparkSession
    wanted = spark.createDataFrame([(r, c) for r in KNOWN_ROLES for c in KNOWN], "role string, label string")
    need = F.when((F.col("role") == "calibration") & (F.col("label") == "Normal"), LEAST_NORMAL).otherwise(LEAST_GROUPS)
    short = wanted.join(groups, ["role", "label"], "left").where(F.coalesce("identities", F.lit(0)) < need)
    few = short.select(F.concat_ws(" ", "role", "label", F.coalesce("identities", F.lit(0)).cast("string")).alias("text"))
    label, role = F.col("label"), F.col("role")
    odd = role.isin(*KNOWN_ROLES) & ~F.coalesce(label.isin(*KNOWN), F.lit(False))
    odd = odd | ((role == "surrogate_ood") & ~F.coalesce(label.isin(*(h for h in HELD_OUT if h != target)), F.lit(False)))
    strange = groups.where(odd).select(F.concat_ws(" ", "role", F.coalesce("label", F.lit("null")), F.lit("undeclared")))
    present = groups.select("role").distinct()
    missing = spark.createDataFrame([(r,) for r in ROLES], "role string").join(present, "role", "left_anti").select(F.concat_ws(" ", "role", F.lit("empty")))
    texts = few.union(strange).union(missing)  # at most roles times labels
    return texts.agg(F.lit("required_roles_usable").alias("rule"), F.count(F.lit(1)).alias("broken"), F.slice(F.array_sort(F.collect_list("text")), 1, evidence).alias("evidence"))


def require_retrainable(fold: DataFrame, target: str, features: list[str], schema: list[str]) -> DataFrame:
    """The fold, if every rule holds; else raises with the rules that do not and their evidence."""
    failed = [(r.rule, r.broken, list(r.evidence)) for r in breaches(fold, target, features, schema).where("broken > 0").orderBy("number").collect()]
    if failed:
        raise ValueError(f"retraining blocked for {target}: {failed}")
    return fold
