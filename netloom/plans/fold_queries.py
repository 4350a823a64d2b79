"""Named queries on folds, support, unseen categories, families and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators import folds as D
from netloom.operators import labels as L
from netloom.plans.base import Query, adder, r6

QUERIES: dict[str, Query] = {}
query = adder(QUERIES)

HELD_SQL = "('Fuzzers', 'Analysis', 'Backdoors', 'Shellcode', 'Worms')"


@query("isolated_fold", "families", sql=f"""
, t AS (SELECT DISTINCT identity FROM families WHERE label = 'Worms'), k AS (SELECT row_id, identity, label, label IN {HELD_SQL} AS held FROM families WHERE label <> 'Worms' AND identity NOT IN (SELECT identity FROM t)),
g AS (SELECT identity, min(label) AS c FROM k WHERE NOT held GROUP BY 1), p AS (SELECT identity, (row_number() OVER (PARTITION BY c ORDER BY sha256('42|' || identity)) - 1) % 10 AS fold FROM g),
r AS (SELECT identity, CASE WHEN fold < 7 THEN 'train' WHEN fold = 7 THEN 'val' WHEN fold = 8 THEN 'meta_known' ELSE 'calibration' END AS role FROM p),
x AS (SELECT r.role, k.identity FROM k JOIN r USING (identity) WHERE NOT held UNION ALL SELECT 'surrogate_ood', identity FROM k WHERE held AND identity NOT IN (SELECT identity FROM g) UNION ALL SELECT 'target', identity FROM families WHERE label = 'Worms')
SELECT role, count(*) AS rows, count(DISTINCT identity) AS identities FROM x GROUP BY role""")
def isolated_fold(df: DataFrame) -> DataFrame:
    fold = D.isolated_fold(df, "Worms")
    assert D.leaks(fold).count() == 0
    return fold.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("identity").alias("identities"))


@query("support_tiers", "families", sql=f"""
, s AS (SELECT label, count(DISTINCT identity) AS identities FROM families WHERE label IN {HELD_SQL} GROUP BY 1)
SELECT label, identities, CASE WHEN identities >= 1000 THEN 'high' WHEN identities >= 200 THEN 'medium' WHEN identities >= 50 THEN 'low' ELSE 'insufficient' END AS tier, row_number() OVER (ORDER BY identities DESC, label) <= 2 AS surrogate FROM s""")
def support_tiers(df: DataFrame) -> DataFrame:
    return D.support_tiers(df)


@query("unseen_categories", "flows", sql="""
, v AS (SELECT DISTINCT coalesce('value:' || lower(trim(service)), 'missing:') AS token FROM flows WHERE l_linenumber % 4 = 1), t AS (SELECT coalesce('value:' || lower(trim(service)), 'missing:') AS token FROM flows)
SELECT count(DISTINCT token) FILTER (WHERE token IN (SELECT token FROM v)) AS known, count(DISTINCT token) FILTER (WHERE token NOT IN (SELECT token FROM v)) AS unseen, count(*) FILTER (WHERE token NOT IN (SELECT token FROM v)) AS unseen_rows FROM t""")
def unseen_categories(flows: DataFrame) -> DataFrame:
    return L.unseen_report(flows, "service", L.vocabulary(flows.where("l_linenumber % 4 = 1"), "service"))


@query("unseen_bucket_collisions", "flows", sql="""
, t AS (SELECT DISTINCT 'value:' || srcip AS token FROM flows), h AS (SELECT ('0x' || substr(sha256('["category-v1","srcip","' || token || '"]'), 57, 8))::BIGINT AS h FROM t), b AS (SELECT unnest([10, 16, 20, 24]) AS bits),
c AS (SELECT bits, h % (1 << bits)::BIGINT AS k, count(*) AS n FROM h, b GROUP BY ALL) SELECT bits, count(*) FILTER (WHERE n > 1) AS colliding_buckets, sum(n * (n - 1) // 2)::BIGINT AS colliding_pairs FROM c GROUP BY bits""")
def unseen_bucket_collisions(flows: DataFrame) -> DataFrame:
    return D.bucket_collisions(flows, "srcip", (10, 16, 20, 24))


@query("family_recall", "scores", "families", sql="""
, f AS (SELECT row_id AS source_row, min(label) AS family FROM families GROUP BY 1), d AS (SELECT s.*, f.family, ((hybrid_score > 0.35)::INT + (ae_score > 0.55)::INT + (1 - max_prob > 0.25)::INT) >= 2 AS z FROM scores s JOIN f USING (source_row))
SELECT family, count(*) AS support, round(avg(z::INT), 6) AS detected, round(avg((classifier_class = family)::INT), 6) AS recall FROM d GROUP BY family""")
def family_recall(scores: DataFrame, families: DataFrame) -> DataFrame:
    from netloom.plans.quality_queries import decided

    one = families.groupBy(F.col("row_id").alias("source_row")).agg(F.min("label").alias("family"))
    return D.family_recall(decided(scores).join(one, "source_row"))


@query("macro_recall", "scores", "families", sql="""
, f AS (SELECT row_id AS source_row, min(label) AS family FROM families GROUP BY 1), r AS (SELECT family, count(*) AS n, avg((classifier_class = family)::INT) AS x FROM scores JOIN f USING (source_row) GROUP BY family)
SELECT round(avg(x), 6) AS macro, round(stddev_pop(x), 6) AS spread, round(sum(x * n) / sum(n), 6) AS weighted FROM r""")
def macro_recall(scores: DataFrame, families: DataFrame) -> DataFrame:
    one = families.groupBy(F.col("row_id").alias("source_row")).agg(F.min("label").alias("family"))
    per = scores.join(one, "source_row").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("classifier_class") == F.col("family")).cast("double")).alias("x"))
    out = per.agg(F.avg("x").alias("macro"), F.stddev_pop("x").alias("spread"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("weighted"))
    return out.select(*r6("macro", "spread", "weighted"))


@query("evaluation_cells", "families", sql=f"""
, t AS (SELECT DISTINCT label AS target FROM families WHERE label IN {HELD_SQL}), s AS (SELECT unnest([42, 43, 44]) AS seed), u AS (SELECT unnest(['CLEAN', 'ALL']) AS surface) SELECT target, seed, surface FROM t, s, u""")
def evaluation_cells(df: DataFrame) -> DataFrame:
    return D.cells(df, (42, 43, 44), ("CLEAN", "ALL"))


@query("nearest_class_mean", "flows", sql="""
, u AS (SELECT DISTINCT ON (row_id) row_id, dsport, spkts, dpkts FROM flows ORDER BY row_id, l_partkey, l_suppkey, spkts), c AS (SELECT dsport, avg(spkts) AS a, avg(dpkts) AS b FROM u GROUP BY 1),
d AS (SELECT row_id, sqrt((spkts - a) * (spkts - a) + (dpkts - b) * (dpkts - b)) AS d FROM u, c) SELECT row_id, round(min(d), 6) AS distance FROM d GROUP BY row_id""")
def nearest_class_mean(flows: DataFrame) -> DataFrame:
    u = flows.groupBy("row_id").agg(F.min_by(F.struct("dsport", F.array("spkts", "dpkts").alias("v")), F.struct("l_partkey", "l_suppkey", "spkts")).alias("x")).select("row_id", "x.*")
    near = L.nearest_centroid(u, L.centroids(u, "dsport", "v"), "dsport", "row_id", "v")
    return near.select("row_id", *r6("distance"))


@query("alert_entities", "flows", sql="""
SELECT row_id, l_partkey, l_suppkey, CASE WHEN lower(trim(coalesce(service, ''))) NOT IN ('', 'nan', 'none', 'null', '-', 'unknown') THEN trim(service) WHEN lower(trim(coalesce(attack_raw, ''))) NOT IN ('', 'nan', 'none', 'null', '-', 'unknown') THEN trim(attack_raw) ELSE '' END AS entity FROM flows""")
def alert_entities(flows: DataFrame) -> DataFrame:
    return flows.select("row_id", "l_partkey", "l_suppkey", S.entity(F.col("service"), F.col("attack_raw")).alias("entity"))


@query("provenance_groups", "packets", sql="""
, e AS (SELECT capture_index, unnest(CASE WHEN ip_protocol = 6 THEN ['tcp', 'p' || dst_port] ELSE ['udp'] END) AS scenario, ip_protocol, src_address FROM packets)
SELECT scenario, count(*) AS n, count(DISTINCT src_address) AS sources, string_agg(DISTINCT ip_protocol::VARCHAR, ',' ORDER BY ip_protocol::VARCHAR) AS protocols FROM e GROUP BY scenario""")
def provenance_groups(packets: DataFrame) -> DataFrame:
    ids = F.when(F.col("ip_protocol") == 6, F.array(F.lit("tcp"), F.concat(F.lit("p"), F.col("dst_port").cast("string")))).otherwise(F.array(F.lit("udp")))
    return D.scenario_groups(packets.withColumn("scenarios", ids), "scenarios", "src_address", "ip_protocol")
