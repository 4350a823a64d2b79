"""Named queries on merges of vectors, causes of label conflicts, the retraining gate and training rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import forensics as X
from netloom.operators import retraining as R
from netloom.operators import training as N
from netloom.plans.base import Query, adder, r6

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)

_VALUES = {"price": "l_quantity * 1000 + l_linenumber * 1e-6", "rate": "l_discount + l_suppkey % 3 * 1e-11", "quantity": "l_quantity"}
_DEFINED = ", ".join(f"{e} AS {n}" for n, e in _VALUES.items())


@query("merged_features", "flows", sql=f"""
, v AS (SELECT {_DEFINED}, substr(state, 1, 1) AS role FROM flows),
d AS (SELECT price::FLOAT AS fp, rate::FLOAT AS fr, quantity::FLOAT AS fq, price, rate, quantity, count(*) AS n FROM v GROUP BY ALL),
o AS (SELECT price::FLOAT AS fp, rate::FLOAT AS fr, quantity::FLOAT AS fq, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM v GROUP BY 1, 2, 3),
g AS (SELECT fp, fr, fq, sum(n)::BIGINT AS rows, count(*) AS vectors, min(price) AS lp, max(price) AS hp, min(rate) AS lr, max(rate) AS hr FROM d GROUP BY 1, 2, 3 HAVING count(*) > 1),
e AS (SELECT *, 'price' AS feature, lp AS low, hp AS high FROM g UNION ALL SELECT *, 'rate', lr, hr FROM g),
u AS (SELECT e.*, ((low::FLOAT::BIT::INTEGER + 1)::BIT::FLOAT)::DOUBLE - low::FLOAT::DOUBLE AS last_place FROM e WHERE low < high)
SELECT feature, rows, vectors, roles, round(low, 6) AS low, round(high, 6) AS high, round((high - low) * 1e9, 3) AS nano, round((high - low) / last_place, 6) AS in_last_places FROM u JOIN o USING (fp, fr, fq)""")
def merged_features(flows: DataFrame) -> DataFrame:
    rows = flows.select(*(F.expr(e).alias(n) for n, e in _VALUES.items()), F.substring("state", 1, 1).alias("role"))
    out = X.merged_features(rows, list(_VALUES), "role")
    return out.select("feature", "rows", "vectors", F.array_join("roles", ",").alias("roles"), *r6("low", "high"), F.round(F.col("absolute") * 1e9, 3).alias("nano"), *r6("in_last_places"))


_STAGES = {"encoded": "l_extendedprice * (1 + l_linenumber * 1e-9)", "scaled": "l_extendedprice * (1 + l_linenumber * 1e-9) / 3 + 1e7", "single": "CAST(l_extendedprice * (1 + l_linenumber * 1e-9) / 3 + 1e7 AS FLOAT)"}
_IDENTITY = "proto || '|' || CAST(l_suppkey AS STRING) || '|' || CAST(l_linenumber AS STRING)"


def _merges(after: str, before: str, cause: str) -> str:
    return f"""SELECT '{after}' AS stage, '{cause}' AS cause, count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows, coalesce(sum(ids), 0)::BIGINT AS identities FROM (
  SELECT {after}, sum(n) AS n, sum(ids) AS ids FROM (SELECT {after}, {before}, count(*) AS n, count(DISTINCT identity) AS ids FROM s GROUP BY ALL) GROUP BY {after} HAVING count(*) > 1)"""


@query("merge_causes", "flows", sql=f", s AS (SELECT {_IDENTITY.replace('STRING', 'VARCHAR')} AS identity, " + ", ".join(f"{e} AS {n}" for n, e in _STAGES.items()) + " FROM flows) "
       + " UNION ALL ".join(_merges(a, b, X.CAUSES[a]) for b, a in (("identity", "encoded"), ("encoded", "scaled"), ("scaled", "single"))))
def merge_causes(flows: DataFrame) -> DataFrame:
    rows = flows.select(F.expr(_IDENTITY).alias("identity"), *(F.expr(e).alias(n) for n, e in _STAGES.items()))
    return X.merge_causes(rows, list(_STAGES), "identity")


_EVENT = ["srcip", "dsport", "proto", "service"]
_SAME = "lower(trim(proto)) || '|' || coalesce(service, '-') || '|' || dsport || '|' || (l_suppkey % 50)"


@query("conflict_root_causes", "flows", sql=f"""
, s AS (SELECT {_SAME} AS i, row_id AS r, srcip || '|' || dsport || '|' || proto || '|' || coalesce(service, '-') AS e, trim(attack_raw) AS l, proto FROM flows WHERE attack_raw IS NOT NULL),
g AS (SELECT i, count(*) AS n, count(DISTINCT e) AS events, min(l) <> max(l) AS bad, count(DISTINCT proto) > 1 AND count(DISTINCT lower(trim(proto))) = 1 AS collapsed FROM s GROUP BY i),
ev AS (SELECT i, max((a)::INT) AS a FROM (SELECT i, e, min(l) <> max(l) AS a FROM s GROUP BY ALL) GROUP BY i), re AS (SELECT i, max((a)::INT) AS a FROM (SELECT i, e, r, min(l) <> max(l) AS a FROM s GROUP BY ALL) GROUP BY i)
SELECT count(*) AS conflicting_identities, coalesce(sum(n), 0)::BIGINT AS affected_rows, coalesce(sum(re.a), 0)::BIGINT AS record_conflicts, coalesce(sum(ev.a), 0)::BIGINT AS event_conflicts,
  count(*) FILTER (WHERE events = 1) AS one_event, count(*) FILTER (WHERE events > 1) AS projection_conflicts, count(*) FILTER (WHERE collapsed) AS category_conflicts FROM g JOIN ev USING (i) JOIN re USING (i) WHERE bad""")
def conflict_root_causes(flows: DataFrame) -> DataFrame:
    rows = flows.withColumn("identity", F.expr(_SAME)).withColumn("label", F.trim("attack_raw"))
    return X.root_causes(rows, ["row_id", *_EVENT], _EVENT, [("proto", F.lower(F.trim("proto")))])


_KNOWN = "('Normal', 'Generic', 'Exploits', 'DoS', 'Reconnaissance')"
_FOLD = """
SELECT row_id, label, CASE WHEN label = 'Worms' AND l_orderkey % 40 > 0 THEN 'target' WHEN label IN ('Fuzzers', 'Analysis', 'Backdoors', 'Shellcode', 'Worms') THEN 'surrogate_ood' ELSE role END AS role,
  CASE WHEN l_orderkey % 50 = 0 THEN 'official_test' ELSE 'official_train' END AS source_role, identity AS canonical, coarse || '-' || CAST(l_quantity AS INT) AS model_input FROM {families}
"""


def _on_keys(number: int, kind: str, condition: str) -> str:
    return f"SELECT {number} AS number, count(*) AS broken FROM k WHERE {kind} AND {condition}"


_FIT, _KN, _SU, _CA, _TA = (f"(mask & {sum(1 << R.ROLES.index(r) for r in roles)})" for roles in (R.FIT_ROLES, R.KNOWN_ROLES, ("surrogate_ood",), ("calibration",), ("target",)))
_BIT = "CASE role " + " ".join(f"WHEN '{r}' THEN {1 << i}" for i, r in enumerate(R.ROLES)) + " ELSE 0 END"
_RULES = [
    _on_keys(2, "kind = 'c'", f"{_FIT} > 0 AND {_TA} > 0"), _on_keys(3, "kind = 'm'", f"{_FIT} > 0 AND {_TA} > 0"), _on_keys(4, "kind = 'c'", f"{_SU} > 0 AND {_TA} > 0"), _on_keys(5, "kind = 'm'", f"{_SU} > 0 AND {_TA} > 0"),
    _on_keys(7, "kind = 'r'", f"bit_count({_KN}) > 1"), _on_keys(8, "kind = 'c'", f"bit_count({_KN}) > 1"), _on_keys(9, "kind = 'm'", f"bit_count({_KN}) > 1"),
    _on_keys(10, "kind = 'r'", f"bit_count({_FIT}) > 1"), _on_keys(11, "kind = 'c'", f"bit_count({_FIT}) > 1"), _on_keys(12, "kind = 'm'", f"bit_count({_FIT}) > 1"),
    _on_keys(14, "kind <> 'r'", f"{_CA} > 0 AND {_TA} > 0"),
    "SELECT 1, count(*) FROM fold WHERE role <> 'target' AND label = 'Worms'", "SELECT 13, count(*) FROM fold WHERE role <> 'target' AND source_role <> 'official_train'", "SELECT 6, 1",
    f"""SELECT 15, (SELECT count(*) FROM (SELECT * FROM (VALUES ('train'), ('val'), ('meta_known'), ('calibration')) a(role), (VALUES ('Normal'), ('Generic'), ('Exploits'), ('DoS'), ('Reconnaissance')) b(label)) ab
        LEFT JOIN (SELECT role, label, count(DISTINCT canonical) AS n FROM fold GROUP BY ALL) g USING (role, label) WHERE coalesce(n, 0) < CASE WHEN role = 'calibration' AND label = 'Normal' THEN 20 ELSE 2 END)
      + (SELECT count(*) FROM (SELECT DISTINCT role, label FROM fold WHERE (role IN ('train', 'val', 'meta_known', 'calibration') AND label NOT IN {_KNOWN}) OR (role = 'surrogate_ood' AND label NOT IN ('Fuzzers', 'Analysis', 'Backdoors', 'Shellcode'))))""",
]


@query("retraining_breaches", "families", sql=f"""
, fold AS ({_FOLD.format(families="families")}), k AS (SELECT kind, key, bit_or(bit) AS mask FROM (SELECT 'r' AS kind, row_id::VARCHAR AS key, {_BIT} AS bit FROM fold UNION ALL SELECT 'c', canonical, {_BIT} FROM fold UNION ALL SELECT 'm', model_input, {_BIT} FROM fold) GROUP BY ALL)
""" + " UNION ALL ".join(f"SELECT number::INTEGER AS number, broken FROM ({r}) x(number, broken)" for r in _RULES))
def retraining_breaches(families: DataFrame) -> DataFrame:
    fold = families.sparkSession.sql(_FOLD.format(families="{f}"), f=families)
    found = R.breaches(fold, "Worms", ["dur", "sbytes", "rate"], ["dur", "sbytes"])
    return found.select("number", "broken")


_FEATURES = ["q", "p", "d", "t", "s"]


@query("training_rounds", "flows")
def training_rounds(flows: DataFrame) -> DataFrame:
    label = F.when(F.col("label") == "0", "Normal").when(F.lower("attack_raw") == "dos", "DoS").otherwise("Other")
    scaled = flows.select("row_id", label.alias("y"), (F.col("l_quantity") / 25 - 1).alias("q"), (F.col("l_extendedprice") / 50_000 - 1).alias("p"), (F.col("l_discount") * 20 - 1).alias("d"), (F.col("l_linenumber") / 4 - 1).alias("t"), (F.col("l_suppkey") % 13 / 6 - 1).alias("s"))
    classes = ["Normal", "DoS", "Other"]
    rows = N.rows_of(scaled.where("row_id % 5 > 0"), "row_id", _FEATURES, "y", classes)
    held = N.rows_of(scaled.where("row_id % 5 = 0"), "row_id", _FEATURES, "y", classes)
    shape = N.Shape(len(_FEATURES), len(classes), hidden=16, blocks=1, ae_hidden=8, projection=(16, 8), contrast=0.1, pair=(1, 2))
    _, history = N.train(rows, held, shape, rounds=6)
    return flows.sparkSession.createDataFrame([tuple(h.values()) for h in history], "round int, rows long, total double, focal double, contrast double, reconstruction double, held double")
