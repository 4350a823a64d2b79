"""Named queries on detectors fitted inside the plan: isolation forest, local outlier factor, class centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import clusters as C
from netloom.operators import displays as D
from netloom.operators import forest as T
from netloom.operators import metrics as M
from netloom.operators import neighbours as N
from netloom.plans.base import Query, adder, r6

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)

FEATURES = ["dur", "sbytes", "dbytes", "dpkts", "sttl", "synack"]
FOREST = {"trees": 100, "per_tree": 256, "most": 10_000}


@query("isolation_forest", "flows", sql=T.forest_sql("flows", "label = '0'", "row_id", FEATURES, **FOREST))
def isolation_forest(flows: DataFrame) -> DataFrame:
    forest = T.fit(flows.where("label = '0'"), "row_id", FEATURES, **FOREST)
    return T.score(flows, "row_id", FEATURES, forest).select("row_id", *r6("isolation"))


NEAR, K, FITTED = ["dur", "synack", "ackdat", "dpkts"], 20, 400
_SAME = " AND ".join(f"a.{c} = b.{c}" for c in NEAR)
_D = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in NEAR) + ")"
_COLUMNS = ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in NEAR)


def _near(name: str, left: str, own: str) -> str:
    return f"""{name}_d AS (SELECT a.id AS id, b.id AS o, {_D} AS d, b.n - {own} AS n FROM {left} a, fit b),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY d, o) - n AS before FROM {name}_d WHERE n > 0),
{name} AS (SELECT id, o, d, least(n, {K} - before) AS w FROM {name}_c WHERE before < {K})"""


LOF_SQL = f"""
, rows AS (SELECT row_id, label, {_COLUMNS} FROM flows),
fit AS (SELECT {", ".join(NEAR)}, min(row_id) AS id, count(*) AS n FROM (FROM rows WHERE label = '0' ORDER BY md5('7|' || row_id), row_id, [{", ".join(NEAR)}] LIMIT {FITTED}) GROUP BY ALL),
ask AS (SELECT {", ".join(NEAR)}, min(row_id) AS id FROM rows GROUP BY ALL),
{_near("s", "fit", "(a.id = b.id)::INT")},
kth AS (SELECT id AS o, max(d) AS kth FROM s GROUP BY 1),
lrd AS (SELECT s.id AS o, 1 / (sum(w * greatest(d, kth)) / sum(w) + 1e-10) AS density FROM s JOIN kth USING (o) GROUP BY 1),
{_near("q", "ask", "0")},
f AS (SELECT q.id AS id, sum(w * density) / sum(w) / (1 / (sum(w * greatest(d, kth)) / sum(w) + 1e-10)) AS factor FROM q JOIN kth USING (o) JOIN lrd USING (o) GROUP BY 1)
SELECT row_id, round(factor, 6) AS factor FROM rows a JOIN ask b ON {_SAME} JOIN f ON f.id = b.id"""


@query("local_outlier_factor", "flows", sql=LOF_SQL)
def local_outlier_factor(flows: DataFrame) -> DataFrame:
    normal = flows.where("label = '0'").withColumn("key", F.col("row_id")).withColumn("x", T.values(NEAR))
    fitted = T.least_by_digest(normal, FITTED, normal.count(), 7)
    return N.outlier_factor(flows, fitted, "row_id", NEAR, K).select("row_id", *r6("factor"))


@query("baseline_ranking", "flows", "scores", sql=T.forest_sql("flows", "label = '0'", "row_id", FEATURES, **FOREST).rsplit("\nSELECT", 1)[0] + """
, iso AS (SELECT round(isolation, 6) AS v, attack FROM (SELECT """ + "[" + ", ".join(f"coalesce({f}, 0)::DOUBLE" for f in FEATURES) + """] AS x, label <> '0' AS attack FROM flows) JOIN scored USING (x)),
each AS (SELECT 'isolation_forest' AS method, v, attack FROM iso
         UNION ALL SELECT 'hybrid', round(hybrid_score, 6), label <> '0' FROM scores UNION ALL SELECT 'reconstruction', round(ae_score, 6), label <> '0' FROM scores),
cut AS (SELECT method, quantile_cont(v, 0.95) AS cut FROM each WHERE NOT attack GROUP BY 1),
x AS (SELECT method, v, count(*) FILTER (WHERE attack) AS p, count(*) FILTER (WHERE NOT attack) AS n FROM each GROUP BY ALL),
r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM x WINDOW w AS (PARTITION BY method ORDER BY v DESC)),
m AS (SELECT method, round(sum(n * (tp - p) + n * p / 2.0) / (sum(p) * sum(n)), 6) AS auroc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS auprc FROM r GROUP BY 1),
a AS (SELECT method, round(avg((v > cut + 1e-9)::INT), 6) AS alert_rate, round(avg((v > cut + 1e-9)::INT) FILTER (WHERE NOT attack), 6) AS normal_fpr, round(avg((v > cut + 1e-9)::INT) FILTER (WHERE attack), 6) AS attack_detection_rate FROM each JOIN cut USING (method) GROUP BY 1)
SELECT method, auroc, auprc, alert_rate, normal_fpr, attack_detection_rate, row_number() OVER (ORDER BY auroc DESC, normal_fpr, method)::INTEGER AS rank FROM m JOIN a USING (method)""")
def baseline_ranking(flows: DataFrame, scores: DataFrame) -> DataFrame:
    forest = T.fit(flows.where("label = '0'"), "row_id", FEATURES, **FOREST)
    marked = flows.withColumn("row", F.struct("row_id", "label"))  # row ids repeat: the label comes along
    iso = T.score(marked, "row", FEATURES, forest).select("row.*", "isolation").select(F.lit("isolation_forest").alias("method"), F.round("isolation", 6).alias("v"), "label")
    own = [scores.select(F.lit(name).alias("method"), F.round(column, 6).alias("v"), "label") for name, column in (("hybrid", "hybrid_score"), ("reconstruction", "ae_score"))]
    every = iso.unionByName(own[0]).unionByName(own[1]).select("method", "v", (F.col("label") != "0").alias("attack"))
    out = M.compared_methods(every, 0.05)
    ranked = D.ranked_methods(out.withColumn("ood_detection_rate", F.lit(None).cast("double")), "method").drop("ood_detection_rate")
    return ranked.select("method", *r6("auroc", "auprc", "alert_rate", "normal_fpr", "attack_detection_rate"), "rank")


_X = ["dur", "ackdat", "synack", "dpkts"]
_V = "[dur / 5, ackdat * 10, synack * 10, dpkts / 7]"


def _class_rows(flows: DataFrame) -> DataFrame:
    v = F.array(F.col("dur") / 5, F.col("ackdat") * 10, F.col("synack") * 10, F.col("dpkts") / 7)
    return C.usable(flows.withColumn("_v", v).withColumn("_c", F.lower(F.trim(F.coalesce("attack_raw", F.lit("normal"))))), "_c", "row_id", "_v")


_DSQ = " + ".join(f"(r.x[{i}] - c.x[{i}]) ** 2" for i in range(1, 5))


@query("class_centres_step", "flows", sql=f"""
, rows AS (SELECT row_number() OVER () AS u, row_id, lower(trim(coalesce(attack_raw, 'normal'))) AS label, {_V}::DOUBLE[] AS x FROM flows),
c AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id, x) - 1 AS centre FROM rows QUALIFY centre < 25),
near AS (SELECT r.label AS label, r.x AS x, centre, {_DSQ} AS d FROM rows r JOIN c ON c.label = r.label QUALIFY row_number() OVER (PARTITION BY r.u ORDER BY d, centre) = 1)
SELECT label, centre::INTEGER AS centre, count(*) AS n, round(sum(d), 4) AS cost, round(avg(x[1]), 6) AS x1, round(avg(x[2]), 6) AS x2, round(avg(x[3]), 6) AS x3, round(avg(x[4]), 6) AS x4 FROM near GROUP BY ALL""")
def class_centres_step(flows: DataFrame) -> DataFrame:
    rows = _class_rows(flows)
    out = C.step(rows, C.first_rows(rows, 25)).where("n > 0")
    return out.select("label", "centre", "n", F.round("cost", 4).alias("cost"), *(F.round(F.col("sums")[i] / F.col("n"), 6).alias(f"x{i + 1}") for i in range(4)))


@query("class_centres", "flows")
def class_centres(flows: DataFrame) -> DataFrame:
    rows = _class_rows(flows)
    found, costs = C.centres(rows)
    assert all(b <= a * (1 + 1e-12) for a, b in zip(costs, costs[1:], strict=False))
    return C.table(rows, found)
