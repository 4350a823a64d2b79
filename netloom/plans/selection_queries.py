"""Named queries on the choice of a scorer by development data and the run on external rows, for every seed at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import selection as C
from netloom.operators.staged import staged
from netloom.plans.base import Query, adder, r6

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)

_ROLE = "CASE WHEN source_row % 17 < 8 THEN 'train' WHEN source_row % 17 < 11 THEN 'meta_known' WHEN source_row % 17 < 13 THEN 'surrogate_ood' WHEN source_row % 17 < 15 THEN 'calibration' ELSE 'external' END"
_SQL = f"""
, r AS (SELECT seed, classifier_class, identity, label, {_ROLE} AS role, [ae_score, hybrid_score, softmax] AS x, [max_prob * 3, ae_score, softmax] AS z FROM scores),
c AS (SELECT seed, classifier_class, avg(x[1]) AS a, avg(x[2]) AS b, avg(x[3]) AS c FROM r WHERE role = 'train' GROUP BY ALL),
s AS (SELECT r.*, -exp(greatest(z[1], z[2], z[3])) / (exp(z[1]) + exp(z[2]) + exp(z[3])) AS soft, (SELECT min(sqrt((x[1] - a) ** 2 + (x[2] - b) ** 2 + (x[3] - c) ** 2)) FROM c WHERE c.seed = r.seed) AS near FROM r),
l AS (SELECT seed, role, identity, label, 'negative_max_softmax' AS scorer, round(soft, 9) AS v FROM s UNION ALL SELECT seed, role, identity, label, 'nearest_centroid_l2', round(near, 9) FROM s),
m AS (SELECT seed, scorer, role, identity, round(avg(v), 8) AS v FROM l WHERE role IN ('meta_known', 'surrogate_ood') GROUP BY ALL),
x AS (SELECT seed, scorer, v, count(*) FILTER (WHERE role = 'surrogate_ood') AS p, count(*) FILTER (WHERE role <> 'surrogate_ood') AS n FROM m GROUP BY ALL),
t AS (SELECT *, sum(p) OVER (PARTITION BY seed, scorer ORDER BY v DESC) AS tp FROM x),
d AS (SELECT seed, scorer, sum(n)::BIGINT AS known_identities, sum(p)::BIGINT AS surrogate_identities, sum(n * (tp - p) + n * p / 2.0) / (sum(p) * sum(n)) AS auroc FROM t GROUP BY ALL),
k AS (SELECT seed, max(auroc) FILTER (WHERE scorer = 'nearest_centroid_l2') - max(auroc) FILTER (WHERE scorer <> 'nearest_centroid_l2') AS margin FROM d GROUP BY seed),
ch AS (SELECT seed, margin, CASE WHEN margin >= -1e-12 THEN 'nearest_centroid_l2' ELSE 'negative_max_softmax' END AS selected FROM k)"""


def _rows(scores: DataFrame) -> DataFrame:
    rows = scores.select("seed", F.col("classifier_class").alias("label"), F.col("label").alias("truth"), "identity", F.expr(_ROLE).alias("role"), F.array("ae_score", "hybrid_score", "softmax").alias("representation"), F.array(F.col("max_prob") * 3, "ae_score", "softmax").alias("logits"))
    scored = C.with_scores(rows, ["seed"], 3)
    return staged(scored.withColumns({s: F.round(s, 9) for s in C.SCORERS}))  # so that sums in another order compare equal


def _statistics(rows: DataFrame) -> DataFrame:
    return C.development(rows, ["seed"])


@query("scorer_development", "scores", sql=_SQL.replace("round(avg(v), 8)", "avg(v)") + " SELECT seed, scorer, known_identities, surrogate_identities, round(auroc, 3) AS auroc FROM d")
def scorer_development(scores: DataFrame) -> DataFrame:
    return _statistics(_rows(scores)).select("seed", "scorer", "known_identities", "surrogate_identities", F.round("auroc", 3).alias("auroc"))


@query("external_scoring", "scores", sql=_SQL + """,
f AS (SELECT l.seed, selected, v, row_number() OVER (PARTITION BY l.seed ORDER BY v) AS i, count(*) OVER (PARTITION BY l.seed) AS n FROM l JOIN ch ON ch.seed = l.seed AND ch.selected = l.scorer WHERE role = 'calibration'),
h AS (SELECT seed, selected, min(v) AS threshold, max(n) AS calibration_rows FROM f WHERE i >= ceil((n - 1) * 0.99) + 1 GROUP BY ALL),
e AS (SELECT l.seed, h.selected, threshold, v > threshold AS alert, label <> '0' AS p FROM l JOIN h ON h.seed = l.seed AND h.selected = l.scorer WHERE role = 'external')
SELECT seed, selected, round(threshold, 6) AS threshold, count(*) AS rows, count(*) FILTER (WHERE p AND alert) AS tp, count(*) FILTER (WHERE NOT p AND alert) AS fp, count(*) FILTER (WHERE NOT p AND NOT alert) AS tn, count(*) FILTER (WHERE p AND NOT alert) AS fn,
  round(count(*) FILTER (WHERE p AND alert) / count(*) FILTER (WHERE p), 6) AS tpr, round(count(*) FILTER (WHERE NOT p AND alert) / count(*) FILTER (WHERE NOT p), 6) AS fpr FROM e GROUP BY ALL""")
def external_scoring(scores: DataFrame) -> DataFrame:
    rows = _rows(scores)
    choice = staged(C.chosen(_statistics(rows), ["seed"]))  # a row a cell
    frozen = staged(C.thresholds(rows, choice, ["seed"]))
    out = C.external_run(rows, frozen, ["seed"], F.col("truth") != "0")
    return out.select("seed", "selected", *r6("threshold"), "rows", "tp", "fp", "tn", "fn", *r6("tpr", "fpr"))
