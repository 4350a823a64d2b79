"""k-means centres of every class at once.

The state is a small table of centres, at most `k` a class; each round sends it to all executors, assigns the rows in
Arrow batches, and adds partial sums: a class of any size costs its tasks only, and a round shuffles one row for each
task and centre. Seeds are drawn in a few rounds by distance (scalable k-means++): a row is a candidate by a hash of
its key against its share of the class's cost, and the few candidates, weighted by the rows near them, are thinned to k.

Rows with a null label, a null vector or components that are not finite take no part. A class with at most k distinct
vectors has one centre for each of them; a centre that loses all its rows stays where it was. Ties go to the first centre.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.grouped import in_groups
from netloom.operators.staged import released, staged

#: Rounds of seeding, and candidates a round and centre on average.
ROUNDS, OVERSAMPLED = 4, 2


def usable(df: DataFrame, label: str, key: str, vector: str, unit: bool = False) -> DataFrame:
    """label, key, x of the rows that take part; unit: vectors scaled to length 1, as normalised embeddings are."""
    x = F.col(vector).cast("array<double>")
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.col(label).isNotNull() & (F.size(vector) > 0)
    rows = df.where(good).select(F.col(label).cast("string").alias("label"), F.col(key).cast("string").alias("key"), x.alias("x"))
    if not unit:
        return rows
    length = F.greatest(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-12))
    return rows.withColumn("x", F.transform("x", lambda v: v / length))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(centres)))
    for i in range(x.shape[1]):
        total += (x[:, i, None] - centres[None, :, i]) ** 2
    return total


def _classes(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each class of a batch: label, places, vectors."""
    coded = batch.column(0).dictionary_encode()
    code, n = coded.indices.to_numpy(), batch.num_rows
    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
    for i, name in enumerate(coded.dictionary.to_pylist()):
        at = np.flatnonzero(code == i)
        yield name, at, x[at]


def once(rows: DataFrame) -> DataFrame:
    """label, n, x: each distinct vector of a class with its number of rows, which step() takes in place of the rows."""
    return rows.groupBy("label", "x").agg(F.count(F.lit(1)).alias("n")).select("label", "n", "x")


def step(rows: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """label, centre (its number), n, cost (sum of squared distances), sums (array): rows assigned to their nearest centre.

    Tasks add in extended precision and give each sum in two parts, whose sum over the tasks is exact: means do not
    depend on the order of the rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    weighted = "n" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, at, x in _classes(batch):
                c = shared.value[name]
                n, sums = held.setdefault(name, [np.zeros(len(c), np.int64), np.zeros((len(c), x.shape[1] + 1), np.longdouble)])
                d = squared(x, c)
                near = d.argmin(axis=1)
                times = batch.column(1).to_numpy()[at] if weighted else np.ones(len(x), np.int64)
                np.add.at(n, near, times)
                values = np.column_stack([d[np.arange(len(x)), near], x]).astype(np.longdouble) * times[:, None]
                order = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0]) if len(order) else order
                if len(order):
                    sums[near[order][first]] += np.add.reduceat(values[order], first, axis=0)
        for name, (n, sums) in held.items():
            high = sums.astype(float)
            columns = [pa.array([name] * len(n)), pa.array(range(len(n)), pa.int32()), pa.array(n), *(pa.array(v.tolist(), pa.list_(pa.float64())) for v in (high, (sums - high).astype(float)))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "centre", "n", "high", "low"])

    def added(key: tuple, columns: dict[str, np.ndarray]) -> list[tuple]:
        cost, *sums = (math.fsum(v) for v in zip(*columns["high"], *columns["low"], strict=True))
        return [(*key, int(columns["n"].sum()), cost, sums)]

    parts = rows.mapInArrow(run, "label string, centre int, n long, high array<double>, low array<double>")
    return in_groups(parts, ["label", "centre"], [], added, "label string, centre int, n long, cost double, sums array<double>")


def moved(centres: dict[str, np.ndarray], sums: list) -> tuple[dict[str, np.ndarray], float, float]:
    """The means of the assigned rows, the greatest shift of a centre, and the cost before the move."""
    new = {name: c.copy() for name, c in centres.items()}
    for r in sums:
        if r.n:
            new[r.label][r.centre] = np.array(r.sums) / r.n
    shift = max(float(np.sqrt(((new[name] - c) ** 2).sum(axis=1)).max()) for name, c in centres.items())
    return new, shift, float(sum(r.cost for r in sums))


def _drawn(rows: DataFrame, centres: dict[str, np.ndarray], costs: dict[str, float], each: int, seed: int, turn: int) -> list:
    """Rows drawn by their share of their class's cost, `each` a class on average; not more than four times that is expected."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, costs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, all_costs = shared.value
        for batch in batches:
            drawn, out = batch.column(1).to_numpy(), ([], [])
            for name, at, x in _classes(batch):
                share = squared(x, held[name]).min(axis=1) * each / max(all_costs.get(name, 0.0), 1e-300)
                for i in np.flatnonzero(drawn[at] < share).tolist():
                    out[0].append(name), out[1].append(x[i].tolist())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.list_(pa.float64()))], ["label", "x"])

    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}|{turn}"), F.coalesce("key", F.lit("None"))))
    drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    return rows.select("label", drawn.alias("drawn"), "x").mapInArrow(run, "label string, x array<double>").collect()


def _thinned(points: np.ndarray, weights: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates, each drawn by its weight and squared distance to those already taken."""
    chosen = [int(random.choice(len(points), p=weights / weights.sum()))]
    for _ in range(k - 1):
        gain = squared(points, points[chosen]).min(axis=1) * weights
        if gain.sum() <= 0:
            break
        chosen.append(int(random.choice(len(points), p=gain / gain.sum())))
    return points[chosen]


def first_rows(rows: DataFrame, k: int, seed: int = 42) -> dict[str, np.ndarray]:
    """The vectors of the k rows of least md5 over (seed, key) of each class."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "key"))
    least = rows.groupBy("label").agg(F.min_by("x", F.struct(digest, "key", "x")).alias("x")) if k == 1 else rows.withColumn("_h", digest)
    if k > 1:
        least = least.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("_h", "key", "x"))).where(F.col("_r") <= k).orderBy("label", "_r")
    found: dict[str, list] = {}
    for r in least.collect():
        found.setdefault(r.label, []).append(r.x)
    return {name: np.array(x, float) for name, x in found.items()}


def seeds(rows: DataFrame, k: int, seed: int = 42, vectors: DataFrame | None = None) -> dict[str, np.ndarray]:
    """At most k starting centres for each class. vectors: the rows as once() gives them."""
    vectors = rows if vectors is None else vectors
    centres = first_rows(rows, 1, seed)
    for turn in range(ROUNDS if centres else 0):
        costs: dict[str, float] = {}
        for r in step(vectors, centres).groupBy("label").agg(F.sum("cost").alias("cost")).collect():
            costs[r.label] = r.cost
        if not any(costs.values()):
            break
        for r in _drawn(rows, centres, costs, OVERSAMPLED * k, seed, turn):
            centres[r.label] = np.concatenate([centres[r.label], [r.x]])
    centres = {name: np.unique(c, axis=0) for name, c in centres.items()}
    near = {name: np.zeros(len(c)) for name, c in centres.items()}
    for r in step(vectors, centres).select("label", "centre", "n").collect() if centres else []:
        near[r.label][r.centre] = r.n
    random = np.random.default_rng(seed)
    return {name: c if len(c) <= k else _thinned(c, near[name] + 1e-9, k, random) for name, c in sorted(centres.items())}


def centres(rows: DataFrame, k: int = 25, seed: int = 42, rounds: int = 30, tolerance: float = 1e-4) -> tuple[dict[str, np.ndarray], list[float]]:
    """The centres of each class of usable() rows, and the cost before each round, which never rises."""
    vectors = staged(once(rows))  # rounds read each distinct vector of a class once
    found, costs = seeds(rows, k, seed, vectors), []
    for _ in range(rounds if found else 0):
        found, shift, cost = moved(found, step(vectors, found).collect())
        costs.append(cost)
        if shift <= tolerance:
            break
    released(vectors)
    return found, costs


def table(df: DataFrame, found: dict[str, np.ndarray]) -> DataFrame:
    """label, centre, n, cost, vector of the centres, with the rows nearest to them."""
    schema = "label string, centre int, vector array<double>"
    rows = [(name, i, c.tolist()) for name, cs in found.items() for i, c in enumerate(cs)]
    held = df.sparkSession.createDataFrame(rows, schema)
    if not rows:
        return held.selectExpr("label", "centre", "0L AS n", "0D AS cost", "vector")
    return held.join(step(df, found).drop("sums"), ["label", "centre"], "left").selectExpr("label", "centre", "coalesce(n, 0L) AS n", "coalesce(cost, 0D) AS cost", "vector")
