"""Named queries on identities, conflicts, leakage, purges and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import identity as I
from netloom.plans.base import Query, adder, r6

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)

KNOWN_SQL = "('Normal', 'DoS', 'Exploits', 'Reconnaissance', 'Generic')"


@query("collision_taxonomy", "families", sql="""
, p AS (SELECT role, identity, label, count(*) AS n FROM families GROUP BY ALL), g AS (SELECT role, identity, sum(n) AS rows, sum(n - 1) AS extra, max(n) AS most, count(*) AS labels FROM p GROUP BY ALL)
SELECT role, count(*) FILTER (WHERE most > 1) AS same_label_identities, sum(extra)::BIGINT AS duplicate_rows, count(*) FILTER (WHERE labels > 1) AS cross_label_identities, sum(CASE WHEN labels > 1 THEN rows ELSE 0 END)::BIGINT AS cross_label_rows FROM g GROUP BY role""")
def collision_taxonomy(df: DataFrame) -> DataFrame:
    return I.taxonomy(df)


OVERLAP_SQL = """
, d AS (SELECT DISTINCT identity, role, label FROM families), s AS (SELECT identity, role, list_sort(list(label)) AS ls FROM d GROUP BY ALL),
o AS (SELECT a.role AS left_role, b.role AS right_role, count(*) AS shared, count(*) FILTER (WHERE list_has_any(a.ls, b.ls)) AS same_label, count(*) FILTER (WHERE len(list_distinct(list_concat(a.ls, b.ls))) > 1) AS cross_label
  FROM s a JOIN s b ON a.identity = b.identity AND a.role < b.role GROUP BY ALL)"""


@query("role_overlaps", "families", sql=OVERLAP_SQL + " SELECT * FROM o")
def role_overlaps(df: DataFrame) -> DataFrame:
    return I.role_overlaps(df)


@query("collision_gate", "families", sql=OVERLAP_SQL + """,
c AS (SELECT role, count(*) AS n FROM (SELECT role, identity FROM families GROUP BY ALL HAVING count(DISTINCT label) > 1) GROUP BY role)
SELECT 'CRITICAL FAIL' AS severity, 'same_role_cross_label' AS reason, role AS place, n AS identities FROM c UNION ALL SELECT 'CRITICAL FAIL', 'cross_role_cross_label', left_role || '__' || right_role, cross_label FROM o WHERE cross_label > 0
UNION ALL SELECT 'FAIL', 'cross_role_same_label', left_role || '__' || right_role, same_label FROM o WHERE same_label > 0""")
def collision_gate(df: DataFrame) -> DataFrame:
    out = I.gate(I.taxonomy(df), I.role_overlaps(df))
    return out.select("severity", "reason", "place", F.col("identities").cast("long").alias("identities"))


@query("ambiguity_impact", "families", sql="""
, b AS (SELECT identity FROM families GROUP BY 1 HAVING count(DISTINCT label) > 1)
SELECT label, count(*) AS original, count(b.identity) AS excluded, count(*) - count(b.identity) AS kept, count(DISTINCT CASE WHEN b.identity IS NULL THEN f.identity END) AS kept_identities FROM families f LEFT JOIN b USING (identity) GROUP BY label""")
def ambiguity_impact(df: DataFrame) -> DataFrame:
    return I.ambiguity_impact(df)


@query("label_pair_conflicts", "families", sql=f"""
, d AS (SELECT DISTINCT identity, label FROM families)
SELECT a.label AS label_a, b.label AS label_b, count(*) AS identities, max(((a.label IN {KNOWN_SQL}) <> (b.label IN {KNOWN_SQL}))::INT) AS known_held_out FROM d a JOIN d b ON a.identity = b.identity AND a.label < b.label GROUP BY ALL""")
def label_pair_conflicts(df: DataFrame) -> DataFrame:
    return I.label_pairs(df)


@query("group_classes", "families", sql=f"""
, s AS (SELECT identity, count(*) AS n, list_distinct(list(label)) AS ls FROM families GROUP BY 1), t AS (SELECT unnest(['Fuzzers', 'Analysis', 'Backdoors', 'Shellcode', 'Worms']) AS target),
x AS (SELECT target, n, ls, len(ls) AS k, list_contains(ls, target) AS has, list_has_any(ls, ['Normal', 'DoS', 'Exploits', 'Reconnaissance', 'Generic']) AS kn, list_has_any(ls, ['Fuzzers', 'Analysis', 'Backdoors', 'Shellcode', 'Worms']) AS hd FROM s, t),
y AS (SELECT target, n, unnest(['unambiguous_same_label', 'conflicting_labels', 'target_family_containing', 'known_family_only', 'mixed_known_ood', 'mixed_known_target']) AS class, unnest([k = 1, k > 1, has, NOT hd, kn AND hd, kn AND has]) AS f FROM x)
SELECT target, class, count(*) FILTER (WHERE f) AS groups, sum(CASE WHEN f THEN n ELSE 0 END)::BIGINT AS rows FROM y GROUP BY ALL""")
def group_classes(df: DataFrame) -> DataFrame:
    return I.group_classes(df)


@query("stage_merges", "families", sql="SELECT coarse, count(DISTINCT identity) AS upstream, count(*) AS rows FROM families GROUP BY 1 HAVING count(DISTINCT identity) > 1")
def stage_merges(df: DataFrame) -> DataFrame:
    return I.stage_merges(df, "identity", "coarse")


@query("target_purge", "families", sql="""
, t AS (SELECT DISTINCT identity FROM families WHERE label = 'Worms'), k AS (SELECT * FROM families WHERE label <> 'Worms')
SELECT role, count(*) AS rows, count(t.identity) AS purged_rows, count(DISTINCT t.identity) AS purged_identities FROM k LEFT JOIN t USING (identity) GROUP BY role""")
def target_purge(df: DataFrame) -> DataFrame:
    return I.purge_report(df.where("label <> 'Worms'"), df.where("label = 'Worms'"))


@query("purged_roles", "families", sql="""
, t AS (SELECT DISTINCT identity FROM families WHERE label = 'Worms') SELECT role, label, count(*) AS n FROM families WHERE label <> 'Worms' AND identity NOT IN (SELECT identity FROM t) GROUP BY ALL""")
def purged_roles(df: DataFrame) -> DataFrame:
    return I.purged(df.where("label <> 'Worms'"), df.where("label = 'Worms'")).groupBy("role", "label").agg(F.count(F.lit(1)).alias("n"))


@query("priority_purge", "families", sql="""
, r AS (SELECT *, CASE role WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'meta_known' THEN 3 ELSE 4 END AS p FROM families), m AS (SELECT *, min(p) OVER (PARTITION BY identity) AS b FROM r)
SELECT role, count(*) AS n, count(DISTINCT identity) AS identities FROM m WHERE p = b GROUP BY role""")
def priority_purge(df: DataFrame) -> DataFrame:
    return I.by_priority(df).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("identity").alias("identities"))


SURFACE_SQL = """
, tr AS (SELECT * FROM families WHERE role = 'train'), te AS (SELECT * FROM families WHERE role <> 'train'), c1 AS (SELECT identity FROM tr GROUP BY 1 HAVING count(DISTINCT label) > 1), c2 AS (SELECT identity FROM te GROUP BY 1 HAVING count(DISTINCT label) > 1),
x AS (SELECT *, CASE WHEN identity IN (SELECT identity FROM c1) THEN 'TRAIN-CONFLICT-RELATED' WHEN identity IN (SELECT identity FROM c2) THEN 'TEST-INTERNAL-AMBIGUOUS' WHEN identity IN (SELECT identity FROM tr) THEN 'DEVELOPMENT-OVERLAP' ELSE 'CLEAN' END AS test_category FROM te)"""


@query("test_surfaces", "families", sql=SURFACE_SQL + " SELECT label, test_category, count(*) AS rows, count(DISTINCT identity) AS identities FROM x GROUP BY CUBE (label, test_category)")
def test_surfaces(df: DataFrame) -> DataFrame:
    return I.support(I.test_surfaces(df.where("role <> 'train'"), df.where("role = 'train'")))


@query("session_overlap", "families", sql="""
, a AS (SELECT identity, string_agg(DISTINCT k, '+' ORDER BY k) AS l FROM (SELECT identity, CASE WHEN label = 'Normal' THEN 'NORMAL' ELSE 'ATTACK' END AS k FROM families WHERE role = 'train') GROUP BY 1),
b AS (SELECT identity, string_agg(DISTINCT k, '+' ORDER BY k) AS l FROM (SELECT identity, CASE WHEN label = 'Normal' THEN 'NORMAL' ELSE 'ATTACK' END AS k FROM families WHERE role = 'val') GROUP BY 1)
SELECT count(a.l) AS a_identities, count(b.l) AS b_identities, count(*) FILTER (WHERE a.l IS NOT NULL AND b.l IS NOT NULL) AS shared, count(*) AS "all",
  count(*) FILTER (WHERE (a.l = 'NORMAL' AND b.l = 'ATTACK') OR (a.l = 'ATTACK' AND b.l = 'NORMAL')) AS cross_label, round(count(*) FILTER (WHERE a.l IS NOT NULL AND b.l IS NOT NULL) / count(*), 6) AS jaccard FROM a FULL JOIN b USING (identity)""")
def session_overlap(df: DataFrame) -> DataFrame:
    kinds = df.select("role", "identity", F.when(F.col("label") == "Normal", "NORMAL").otherwise("ATTACK").alias("label"))
    out = I.session_overlap(kinds.where("role = 'train'"), kinds.where("role = 'val'"))
    return out.select("a_identities", "b_identities", "shared", "all", "cross_label", *r6("jaccard"))


@query("grouped_split", "families", sql="""
, g AS (SELECT identity, min(label) AS c FROM families GROUP BY 1), p AS (SELECT identity, (row_number() OVER (PARTITION BY c ORDER BY sha256('42|' || identity)) - 1) % 10 AS fold FROM g),
r AS (SELECT identity, CASE WHEN fold < 7 THEN 'train' WHEN fold = 7 THEN 'val' WHEN fold = 8 THEN 'meta_known' ELSE 'calibration' END AS role FROM p)
SELECT r.role, f.label, count(*) AS n, count(DISTINCT f.identity) AS identities FROM families f JOIN r USING (identity) GROUP BY ALL""")
def grouped_split(df: DataFrame) -> DataFrame:
    return I.grouped_split(df.drop("role"), every_fold=True).groupBy("role", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("identity").alias("identities"))


@query("role_lineage", "families", sql="""
, h AS (SELECT DISTINCT role, sha256(identity) AS h FROM families), p AS (SELECT role, substr(h, 1, 2) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS p FROM h GROUP BY ALL) SELECT role, sha256(string_agg(b || p, ',' ORDER BY b || p)) AS digest FROM p GROUP BY role""")
def role_lineage(df: DataFrame) -> DataFrame:
    return I.set_digest(df, "role", "identity")


#: Values that differ in double precision only, in the sign of zero, or in the case of a text.
FLOAT_SQL = ", x AS (SELECT *, (sbytes + l_linenumber * 1e-9)::FLOAT AS a, (CASE WHEN l_linenumber % 2 = 0 THEN dur ELSE -0.0 * dur END)::FLOAT + 0::FLOAT AS b, CASE WHEN l_suppkey % 2 = 0 THEN upper(service) ELSE service END AS s FROM flows)"


def _close(flows: DataFrame) -> DataFrame:
    signed = F.when(F.col("l_linenumber") % 2 == 0, F.col("dur")).otherwise(F.lit(-0.0) * F.col("dur"))
    return flows.select("*", (F.col("sbytes") + F.col("l_linenumber") * F.lit(1e-9)).alias("a"), signed.alias("b"), F.when(F.col("l_suppkey") % 2 == 0, F.upper("service")).otherwise(F.col("service")).alias("s"))


def _counted(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("identity").alias("identities"), F.count(F.lit(1)).alias("rows"))


@query("feature_fingerprints", "flows", sql=FLOAT_SQL + " SELECT count(DISTINCT a::VARCHAR || '|' || b::VARCHAR || '|' || coalesce(s, '-missing-') || '|' || proto) AS identities, count(*) AS rows FROM x")
def feature_fingerprints(flows: DataFrame) -> DataFrame:
    return _counted(I.with_identity(_close(flows), ["a", "b"], ["s", "proto"]))


@query("canonical_fingerprints", "flows", sql=FLOAT_SQL + " SELECT count(DISTINCT a::VARCHAR || '|' || b::VARCHAR || '|' || coalesce(lower(trim(s)), '-missing-') || '|' || lower(trim(proto))) AS identities, count(*) AS rows FROM x")
def canonical_fingerprints(flows: DataFrame) -> DataFrame:
    return _counted(I.with_canonical_identity(_close(flows), ["a", "b"], ["s", "proto"]))


@query("input_fingerprints", "flows", sql=FLOAT_SQL + " SELECT count(DISTINCT a::VARCHAR || '|' || b::VARCHAR) AS identities, count(*) AS rows FROM x")
def input_fingerprints(flows: DataFrame) -> DataFrame:
    return _counted(I.with_input_identity(_close(flows), ["a", "b"]))


SHARE_SQL = ", u AS (SELECT *, ('0x' || substr(md5('7|' || row_id || '|' || label), 1, 8))::BIGINT / 4294967296.0 AS u FROM (SELECT * FROM families WHERE label IN ('Normal', 'DoS', 'Exploits', 'Reconnaissance', 'Generic')))"


@query("row_split_comparator", "families", sql=SHARE_SQL + """,
r AS (SELECT identity, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.8 THEN 'val' WHEN u < 0.9 THEN 'meta_known' ELSE 'calibration' END AS role FROM u), d AS (SELECT DISTINCT identity, role FROM r)
SELECT a.role AS left_role, b.role AS right_role, count(*) AS shared FROM d a JOIN d b ON a.identity = b.identity AND a.role < b.role GROUP BY ALL""")
def row_split_comparator(df: DataFrame) -> DataFrame:
    known = I.row_split(df.where(F.col("label").isin("Normal", "DoS", "Exploits", "Reconnaissance", "Generic")), 7)
    return I.role_intersections(known)


@query("stratified_split", "families", sql=SHARE_SQL + " SELECT label, CASE WHEN u < 0.8 THEN 'train' ELSE 'test' END AS role, count(*) AS rows FROM u GROUP BY ALL")
def stratified_split(df: DataFrame) -> DataFrame:
    known = df.where(F.col("label").isin("Normal", "DoS", "Exploits", "Reconnaissance", "Generic"))
    return I.stratified_split(known, 7, {"train": 0.8, "test": 0.2}).groupBy("label", "role").agg(F.count(F.lit(1)).alias("rows"))


@query("exact_stratified_split", "families", sql="""
, k AS (SELECT * FROM families WHERE label IN ('Normal', 'DoS', 'Exploits', 'Reconnaissance', 'Generic')), c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM k GROUP BY label),
q AS (SELECT *, ceil(total * 0.2 - 1e-9)::BIGINT AS size, n * ceil(total * 0.2 - 1e-9)::BIGINT % total AS rest FROM c), w AS (SELECT *, n * size // total AS whole FROM q),
e AS (SELECT label, n, whole + (row_number() OVER (ORDER BY rest DESC, label) <= size - sum(whole) OVER ())::INT AS test FROM w),
p AS (SELECT label, row_id, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || row_id), row_id) - 1 AS i FROM k)
SELECT label, CASE WHEN i < n - test THEN 'train' ELSE 'test' END AS role, count(*) AS rows, sum(row_id)::BIGINT AS ids FROM p JOIN e USING (label) GROUP BY ALL""")
def exact_stratified_split(df: DataFrame) -> DataFrame:
    known = df.where(F.col("label").isin("Normal", "DoS", "Exploits", "Reconnaissance", "Generic"))
    out = I.exact_split(known, 7, {"train": 0.8, "test": 0.2})
    return out.groupBy("label", "role").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"))


@query("reference_share", "families", sql=", n AS (SELECT *, row_number() OVER (ORDER BY row_id) AS i, count(*) OVER () AS n FROM families) SELECT row_id, i <= round(n * 0.7) AS reference, i > round(n * 0.7) AS evaluated FROM n")
def reference_share(df: DataFrame) -> DataFrame:
    return I.reference_share(df, "row_id", 0.7).select("row_id", "reference", "evaluated")


@query("identity_multiplicity", "families", sql=", m AS (SELECT count(*) AS multiplicity FROM families GROUP BY identity) SELECT multiplicity, count(*) AS identities FROM m GROUP BY 1")
def identity_multiplicity(df: DataFrame) -> DataFrame:
    return I.multiplicity(df)


@query("role_set_operations", "families", sql="""
, a AS (SELECT DISTINCT identity FROM families WHERE role = 'train'), b AS (SELECT DISTINCT identity FROM families WHERE role = 'val')
SELECT 'intersection' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def role_set_operations(df: DataFrame) -> DataFrame:
    a, b = (df.where(F.col("role") == r).select("identity").distinct() for r in ("train", "val"))
    count = lambda x, op: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.intersect(b), "intersection").union(count(a.union(b).distinct(), "union")).union(count(a.subtract(b), "difference"))
