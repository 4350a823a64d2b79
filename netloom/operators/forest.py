"""Isolation forest: random split trees over bounded samples, scores of all rows by vectorised walks.

Rows of one key are told apart by their values. The trees grow inside the plan, one group of at most `per_tree` rows each; what comes to the driver and goes to all
executors are their flattened arrays, whose size is trees * 4 * per_tree numbers whatever the rows. All choices come
from digests of (seed, tree, node), so that a forest does not depend on how rows are partitioned.

Missing and infinite values count as 0, as in the scaled features that detectors get. A forest of an empty reference
raises; constant features are never split, and rows that no split parts share a leaf.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S

#: Euler's constant, for the mean depth of unsuccessful searches in a tree.
EULER = 0.5772156649015329


def mean_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean path to a row among n that are split at random."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def unit(*parts) -> float:
    """A number in [0, 1) from a digest; 52 bits, so that SQL reads the same."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / float(1 << 52)


def values(features: list[str]) -> F.Column:
    return F.array(*(F.coalesce(S.finite(F.col(f)), F.lit(0.0)).cast("double") for f in features))


def least_by_digest(df: DataFrame, n: int, total: int, *parts) -> DataFrame:
    """The n rows of least md5 over (parts, key). A cut by the digest leaves about 4 n rows to order."""
    digest = F.md5(F.concat_ws("|", *(F.lit(str(p)) for p in parts), F.col("key").cast("string")))
    rows = df.withColumn("_h", digest)
    if total > 8 * n:
        rows = rows.where(F.conv(F.substring("_h", 1, 12), 16, 10).cast("long") < int((1 << 48) * 4 * n / total))
    return rows.orderBy("_h", "key", *(["x"] if "x" in df.columns else [])).limit(n).drop("_h")


def grow(x: np.ndarray, seed: int, tree: int, depth: int) -> list[tuple[int, int, float, int]]:
    """(node, feature or -1, threshold, rows) of every node; the children of node i are 2 i and 2 i + 1."""
    out, level = [], [(1, x)]
    for at in range(depth + 1):
        below = []
        for node, rows in level:
            low, high = rows.min(axis=0), rows.max(axis=0)
            split = np.flatnonzero(high > low)
            if at == depth or len(rows) <= 1 or not len(split):
                out.append((node, -1, 0.0, len(rows)))
                continue
            f = int(split[int(unit(seed, tree, node, "feature") * len(split))])
            cut = low[f] + unit(seed, tree, node, "cut") * (high[f] - low[f])
            cut = float(low[f] if cut >= high[f] else cut)
            out.append((node, f, cut, len(rows)))
            over = rows[:, f] > cut
            below += [(2 * node, rows[~over]), (2 * node + 1, rows[over])]
        level = below
    return out


class Forest:
    """Flattened trees: feature and threshold of every node by its number, and the path length of every leaf."""

    def __init__(self, nodes: pd.DataFrame, trees: int, per_tree: int, depth: int):
        shape = (trees, 2 << depth)
        self.depth, self.per_tree = depth, per_tree
        self.feature, self.cut, self.path = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
        at = nodes.tree.to_numpy(), nodes.node.to_numpy()
        self.feature[at], self.cut[at] = nodes.feature, nodes.cut
        self.path[at] = np.floor(np.log2(nodes.node)) + mean_depth(nodes.rows.to_numpy())
        # for walks without a question at leaves: below a leaf all rows go left, and its path stands in the last level
        self.walk, self.walk_cut, self.walk_path = np.maximum(self.feature, 0).astype(np.int64), np.where(self.feature < 0, np.inf, self.cut), self.path.copy()
        ends = self.feature < 0
        for level in range(depth):
            for node in range(1 << level, 2 << level):
                at_leaf = ends[:, node]
                for below in (2 * node, 2 * node + 1):
                    self.walk_path[at_leaf, below] = self.walk_path[at_leaf, node]
                    self.walk_cut[at_leaf, below] = np.inf
                    ends[at_leaf, below] = True

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / mean depth) of each row: near 1 for rows that few splits part from the rest."""
        total, values = np.zeros(len(x)), np.ascontiguousarray(x, np.float64).ravel()
        base = np.arange(len(x)) * x.shape[1] if len(x) else np.zeros(0, np.int64)
        for feature, cut, path in zip(self.walk, self.walk_cut, self.walk_path, strict=True):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                over = values.take(base + feature.take(node)) > cut.take(node)
                node *= 2
                node += over
            total += path.take(node)
        return 2.0 ** (-(total / len(self.feature)) / max(float(mean_depth(self.per_tree)), 1e-12))


def fit(df: DataFrame, key: str, features: list[str], trees: int = 200, per_tree: int = 256, most: int = 20_000, seed: int = 42) -> Forest:
    """A forest on at most `most` rows of df; each tree sees at most per_tree of them."""
    rows = df.select(F.col(key).alias("key"), values(features).alias("x")).where(F.col("key").isNotNull())
    total = rows.count()
    if not total:
        raise ValueError("the forest needs reference rows")
    pool = least_by_digest(rows, most, total, seed)
    held = min(most, total)
    per_tree = min(per_tree, held)
    depth = max(1, math.ceil(math.log2(max(per_tree, 2))))
    each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    each = each.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("tree").cast("string"), F.col("key").cast("string"))))
    if held > 8 * per_tree:
        each = each.where(F.conv(F.substring("_h", 1, 12), 16, 10).cast("long") < int((1 << 48) * 4 * per_tree / held))
    each = each.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_h", "key", "x"))).where(F.col("_r") <= per_tree)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part.tree.iloc[0])
        found = grow(np.stack(part.sort_values("_r").x.to_numpy()), seed, tree, depth)
        return pd.DataFrame(found, columns=["node", "feature", "cut", "rows"]).assign(tree=tree)[["tree", "node", "feature", "cut", "rows"]]

    nodes = each.select("tree", "_r", "x").groupBy("tree").applyInPandas(one, "tree int, node int, feature int, cut double, rows int").toPandas()
    return Forest(nodes, trees, per_tree, depth)


def score(df: DataFrame, key: str, features: list[str], forest: Forest) -> DataFrame:
    """key, isolation (0 to 1, 0.5 or less for ordinary rows) and anomaly (isolation less 0.5)."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            found = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(found - 0.5)], ["key", "isolation", "anomaly"])

    rows = df.select(F.col(key).alias("key"), values(features).alias("x"))
    plain = rows.select("key", *(F.col("x")[i].alias(f"x{i}") for i in range(len(features))))
    return plain.mapInArrow(run, f"key {dict(df.dtypes)[key]}, isolation double, anomaly double").withColumnRenamed("key", key)


def forest_sql(rows: str, reference: str, key: str, features: list[str], trees: int, per_tree: int, most: int, seed: int = 42) -> str:
    """The same forest and scores for DuckDB, behind a frame: one statement whose levels are written out."""
    depth, n = max(1, math.ceil(math.log2(max(per_tree, 2)))), len(features)
    x = "[" + ", ".join(f"coalesce({f}, 0)::DOUBLE" for f in features) + "]"
    u = lambda what: f"('0x' || substr(sha256('{seed}|' || tree || '|' || node || '|{what}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    ctes = [
        f"pool AS (SELECT {key} AS key, {x} AS x FROM {rows} WHERE {reference} ORDER BY md5('{seed}|' || {key}), {key}, x LIMIT {most})",
        f"n0 AS (SELECT tree, key, 1 AS node, x FROM pool, range({trees}) t(tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY md5('{seed}|' || tree || '|' || key), key, x) <= {per_tree})",
    ]
    for k in range(depth + 1):
        lows, highs = (", ".join(f"{fn}(x[{i + 1}])" for i in range(n)) for fn in ("min", "max"))
        ctes.append(f"b{k} AS (SELECT tree, node, count(*) AS rows, [{lows}] AS lo, [{highs}] AS hi FROM n{k} GROUP BY ALL)")
        if k < depth:
            ctes.append(f"c{k} AS (SELECT *, list_filter(range(1, {n + 1}), lambda i: hi[i] > lo[i]) AS can, {u('feature')} AS uf, {u('cut')} AS uc FROM b{k})")
            ctes.append(f"f{k} AS (SELECT tree, node, lo, hi, uc, can[floor(uf * len(can))::BIGINT + 1] AS f FROM c{k} WHERE rows > 1 AND len(can) > 0)")
            ctes.append(f"d{k} AS (SELECT tree, node, f, CASE WHEN lo[f] + uc * (hi[f] - lo[f]) >= hi[f] THEN lo[f] ELSE lo[f] + uc * (hi[f] - lo[f]) END AS cut FROM f{k})")
            ctes.append(f"n{k + 1} AS (SELECT tree, key, 2 * node + (x[f] > cut)::INT AS node, x FROM n{k} JOIN d{k} USING (tree, node))")
    ctes.append("splits AS (" + " UNION ALL ".join(f"FROM d{k}" for k in range(depth)) + ")")
    ctes.append("ends AS (SELECT tree, node, rows FROM (" + " UNION ALL ".join(f"SELECT tree, node, rows FROM b{k}" for k in range(depth + 1)) + ") ANTI JOIN splits USING (tree, node))")
    length = lambda r: f"CASE WHEN {r} <= 1 THEN 0 WHEN {r} = 2 THEN 1 ELSE 2 * (ln({r} - 1) + {EULER}) - 2 * ({r} - 1) / {r} END"
    ctes.append(f"paths AS (SELECT tree, node, floor(log2(node)) + {length('rows')} AS path FROM ends)")
    ctes.append(f"w0 AS (SELECT x, tree, 1 AS node FROM (SELECT DISTINCT {x} AS x FROM {rows}), range({trees}) t(tree))")
    for k in range(depth):
        ctes.append(f"w{k + 1} AS (SELECT x, w{k}.tree AS tree, CASE WHEN f IS NULL THEN w{k}.node ELSE 2 * w{k}.node + (x[f] > cut)::INT END AS node FROM w{k} LEFT JOIN splits s ON s.tree = w{k}.tree AND s.node = w{k}.node)")
    ctes.append(f"scored AS (SELECT x, 2 ** (-avg(path) / ({length(f'least({per_tree}, (SELECT count(*) FROM pool))')})) AS isolation FROM w{depth} JOIN paths USING (tree, node) GROUP BY x)")
    return ", " + ",\n".join(ctes) + f"\nSELECT {key}, round(isolation, 6) AS isolation FROM (SELECT {key}, {x} AS x FROM {rows}) JOIN scored USING (x)"
