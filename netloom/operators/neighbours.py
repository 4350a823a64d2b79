"""Exact k nearest neighbours by pivots, and the local outlier factor on them.

Reference rows belong to the nearest of a few pivots and, within it, to a ring of distances; a ring holds a bounded
number of rows. A query's distances to the pivots bound its distance to every ring from below and above (triangle
inequality). It visits the ring it would lie in first; the k-th distance found there shuts all rings that cannot hold
a nearer row, and only what is left is visited. Queries and rings meet by a shuffle on the ring, a ring that many
queries visit is given to several tasks, and no pair of rows that does not share a ring is ever formed.

Equal vectors are one row with their number, on both sides, so that copies of any number cost one row. Ties go to
smaller ids. With fewer than k reference rows all of them are neighbours. Missing and infinite values count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.forest import values
from netloom.operators.staged import released, staged

#: Pivots, rows of a ring, the most rings (the rows of a ring grow beyond), and queries of a ring for one task.
PIVOTS, RING, RINGS, VISITS = 48, 1024, 16_384, 20_000


def classes(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """id, x, n: one row for each vector, with its least key and the number of rows."""
    rows = df.select(F.col(key).cast("long").alias("id"), values(features).alias("x")).where(F.col("id").isNotNull())
    return rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "x", "n")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of rows of a and b, summed dimension by dimension in order."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(total)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


class Rings:
    """Where the rings lie: their pivots, least and greatest distance from it, and numbers of rows."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        self.of = np.array([r.p for r in rows], np.int64)
        self.low, self.high = (np.array([getattr(r, c) for r in rows], float) for c in ("low", "high"))
        self.n = np.array([r.rows for r in rows], np.int64)
        self.name = np.array([r.ring for r in rows], np.int64)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each row to the rows of each ring, with room for rounding."""
        d = distances(x, self.pivots)[:, self.of]
        room = 1e-9 * (1 + d + self.high)
        return np.maximum(np.maximum(d - self.high, self.low - d), 0) - room, d + self.high + room

    def reach(self, upper: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each row surely has k reference rows."""
        order = np.argsort(upper, axis=1, kind="stable")
        enough = np.cumsum(self.n[order], axis=1) >= k
        first = np.where(enough.any(axis=1), enough.argmax(axis=1), len(self.n) - 1)
        at = np.take_along_axis(order, first[:, None], axis=1)
        return np.where(enough.any(axis=1), np.take_along_axis(upper, at, axis=1)[:, 0], np.inf)


def ringed(reference: DataFrame, dims: int) -> tuple[DataFrame, Rings]:
    """The reference (id, x, n) with its ring, written once, and where the rings lie."""
    spark = reference.sparkSession
    chosen = reference.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("x").collect()
    if not chosen:
        raise ValueError("there are no reference rows")
    pivots = np.array([r.x for r in chosen], float).reshape(len(chosen), dims)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column(1), dims), shared.value)
                p = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(d[np.arange(len(p)), p])], ["id", "x", "n", "p", "d"])

    placed = staged(reference.select("id", "x", "n").mapInArrow(place, "id long, x array<double>, n long, p long, d double"))
    held = placed.count()
    size = max(RING, -(-held // RINGS))
    rings = F.ceil(F.count(F.lit(1)) / size)
    cuts = placed.groupBy("p").agg(F.percentile_approx("d", F.array(*(F.lit(i / 200) for i in range(1, 200))), F.lit(2000)).alias("all"), rings.alias("k"))
    # of 200 quantiles, those that part a pivot's rows into its number of rings
    step = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("k"), F.lit(200)).cast("int") - 1)), lambda i: F.element_at("all", F.greatest(F.lit(1), F.least(F.lit(199), (i * 200 / F.col("k")).cast("int")))))
    cuts = cuts.select("p", F.when(F.col("k") > 1, F.array_distinct(step)).otherwise(F.array().cast("array<double>")).alias("cuts"))
    inside = F.size(F.filter("cuts", lambda c: c < F.col("d")))
    # a ring beyond 200 quantiles is dealt on by a hash, so that no ring holds more than a few times its size
    split = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(-(-held // (200 * size)))))
    out = staged(placed.join(F.broadcast(cuts), "p").select("id", "x", "n", "p", "d", (F.col("p") * 1_000_000 + inside * 1000 + split).alias("ring")))
    released(placed)
    table = out.groupBy("ring", "p").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.sum("n").alias("rows")).orderBy("ring").collect()
    return out, Rings(pivots, table)


def _visited(pairs: DataFrame, reference: DataFrame, k: int, dims: int, own: bool) -> DataFrame:
    """id, o, d, n: of each (query, ring), the ring's first rows by distance and id until they count k."""
    load = staged(pairs.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("parts")))
    many = reference.join(load, "ring").select("ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "x", "n")
    asked = pairs.join(load, "ring").select("ring", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "x", F.lit(0).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, x, n = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                ring, part, kind = key[a].tolist()
                piece = batch.slice(a, b - a)
                if (ring, part) != now:
                    now, ids, x, n = (ring, part), [], [], []
                own_ids, own_x = piece.column(3).to_numpy(), _matrix(piece.column(4), dims)
                if kind == 0:
                    ids.append(own_ids), x.append(own_x), n.append(piece.column(5).to_numpy())
                    continue
                ids, x, n = [np.concatenate(ids)], [np.concatenate(x)], [np.concatenate(n)]
                for at in range(0, len(own_ids), 512):
                    yield _first(own_ids[at : at + 512], own_x[at : at + 512], ids[0], x[0], n[0], k, own)

    rows = many.unionByName(asked).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ring", "part")
    return rows.sortWithinPartitions("ring", "part", "kind").mapInArrow(run, "id long, o long, d double, n long")


def _first(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, n: np.ndarray, k: int, own: bool) -> pa.RecordBatch:
    d = distances(x, y)
    out = ([], [], [], [])
    for i, name in enumerate(ids.tolist()):
        at = np.arange(len(others))
        if len(at) > 4 * k + 4:  # each row counts one at least, but a query's own
            at = np.flatnonzero(d[i] <= np.partition(d[i], k)[k])
        at = at[np.lexsort((others[at], d[i, at]))]
        count = n[at] - (others[at] == name) if own else n[at]
        upto = np.cumsum(count)
        good = (count > 0) & (upto - count < k)
        out[0].append(np.full(good.sum(), name)), out[1].append(others[at][good]), out[2].append(d[i, at][good]), out[3].append(count[good])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["id", "o", "d", "n"])


def nearest(queries: DataFrame, reference: DataFrame, k: int, dims: int, own: bool = False) -> DataFrame:
    """id, o, d, w: for each query (id, x) its k nearest reference rows (id, x, n), as rows o at distance d that count w times.

    own: queries are reference rows, and each leaves out itself once.
    """
    rows, rings = ringed(reference, dims)
    shared = queries.sparkSession.sparkContext.broadcast(rings)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                low, high = shared.value.bounds(_matrix(part.column(1), dims))
                first = np.lexsort((high, low), axis=1)[:, 0] if len(low) else np.zeros(0, np.int64)
                columns = [part.column(0), part.column(1), pa.array(shared.value.name[first]), pa.array(shared.value.reach(high, k + own))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "x", "ring", "reach"])

    at_home = staged(queries.select("id", "x").mapInArrow(home, "id long, x array<double>, ring long, reach double"))
    found = staged(_visited(at_home, rows, k, dims, own))
    # the k-th distance at home, where home has k rows
    known = found.groupBy("id").agg(F.when(F.sum("n") >= k, F.max("d")).alias("kth"))
    open_ = at_home.join(known, "id", "left").select("id", "x", "ring", F.coalesce(F.least("reach", "kth"), "reach").alias("reach"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                low = shared.value.bounds(_matrix(part.column(1), dims))[0]
                to = (low <= part.column(3).to_numpy()[:, None]) & (shared.value.name[None, :] != part.column(2).to_numpy()[:, None])
                i, j = np.nonzero(to)
                for a in range(0, len(i), 20_000):
                    some = pa.array(i[a : a + 20_000])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(some), part.column(1).take(some), pa.array(shared.value.name[j[a : a + 20_000]])], ["id", "x", "ring"])

    more = staged(open_.mapInArrow(rest, "id long, x array<double>, ring long"))
    every = found.unionByName(_visited(more, rows, k, dims, own))
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("d", "o"))
    every = every.withColumn("_before", upto - F.col("n")).where(F.col("_before") < k)
    out = staged(every.select("id", "o", "d", F.least(F.col("n"), k - F.col("_before")).alias("w")))
    released(rows, at_home, found, more)
    return out


def outlier_factor(df: DataFrame, reference: DataFrame, key: str, features: list[str], k: int = 35) -> DataFrame:
    """key, factor: how much thinner the reference lies about a row than about that row's neighbours; near 1 inside it.

    With fewer than three reference rows it raises; k is at most their number less 1.
    """
    fitted = staged(classes(reference, key, features))
    total = fitted.agg(F.sum("n")).first()[0] or 0
    if total < 3:
        raise ValueError("the local outlier factor needs three reference rows")
    k, dims = min(k, total - 1), len(features)
    near = nearest(fitted, fitted, k, dims, own=True)
    reach = near.groupBy(F.col("id").alias("o")).agg(F.max("d").alias("kth"))

    def density(found: DataFrame) -> DataFrame:
        """id, density: 1 over the mean distance, none counted less than the neighbour's own k-th distance."""
        each = found.join(reach, "o").groupBy("id").agg((F.sum(F.col("w") * F.greatest("d", "kth")) / F.sum("w")).alias("m"))
        return each.select("id", (1 / (F.col("m") + 1e-10)).alias("density"))

    of_fitted = density(near).withColumnRenamed("id", "o")
    # a row of the query: the least key of its vector stands for all
    rows = df.select(F.col(key).alias("_key"), values(features).alias("x")).where(F.col(key).isNotNull())
    asked = staged(classes(df, key, features))
    found = nearest(asked, fitted, k, dims)
    around = found.join(of_fitted.withColumnRenamed("density", "theirs"), "o").groupBy("id").agg((F.sum(F.col("w") * F.col("theirs")) / F.sum("w")).alias("theirs"))
    factor = density(found).join(around, "id").select("id", (F.col("theirs") / F.col("density")).alias("factor"))
    return rows.join(asked.select("id", "x"), "x").join(factor, "id").select(F.col("_key").alias(key), "factor")
