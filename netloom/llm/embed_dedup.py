"""Embedding near-duplicates by Euclidean p-stable hashing.

A normalised vector falls, in each of several tables, into the bucket of K quantised Gaussian projections
floor((a x + b) / W). K grows with the logarithm of the number of vectors, so that far vectors seldom share a
bucket, and the number of tables with the power of it that keeps the chance to meet a pair at the threshold
above RECALL. Pairs in a bucket are checked by exact cosine in double precision, each in the first table that
has both. Equal vectors are one class, found first by a 128-bit hash; one row with their number stands for them.
Buckets of any size are cut into blocks and every pair of blocks is a cell of its own; a cell sends
on link counts and the edges of its spanning forest, never its pairs.

Rows: vectors that are null, zero or hold null or non-finite components, and vectors of another length than a
partner's, link with nothing; a null vec_id gives a row without links and a null component; repeated rows with
one vec_id count as several vectors; labels and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import vectors as V
from netloom.llm.cells import in_cells
from netloom.llm.common import discard, materialize, spread_join
from netloom.llm.components import components

THRESHOLD = 0.95
WIDTH = 2.0
RECALL = 0.995
BLOCK = 1024


def _meets(distance: float, width: float) -> float:
    """Chance that one projection puts two vectors at a distance into one bucket."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Projections a table and tables for n vectors."""
    near, far = _meets(math.sqrt(2 - 2 * threshold), WIDTH), _meets(math.sqrt(2), WIDTH)
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k)))


def _projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_011 + dim)
    return random.standard_normal((dim, k * tables)), random.uniform(0, WIDTH, k * tables)


def bucket_keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """64-bit keys of the rows of x (normalised) in each table."""
    a, b = _projections(x.shape[1], k, tables)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, k).astype(np.uint64)
    keys = np.full((len(x), tables), x.shape[1], np.uint64)
    for i in range(k):
        keys = (keys ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.astype(np.int64)


def hashed(vectors: DataFrame, k: int, tables: int) -> DataFrame:
    """vec_id, class (16 bytes, equal for equal vectors), x (normalised doubles as bytes), keys (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = V.matrix(batch.column(1))
            xs, keys = [b""] * len(rows), [b""] * len(rows)
            classes = [xxhash.xxh3_128_digest((r + 0.0).tobytes()) for r in rows]  # -0.0 becomes 0.0
            for dim in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                x = V.unit(np.stack([rows[i] for i in at]))
                for i, v, key in zip(at, x, bucket_keys(x, k, tables), strict=True):
                    xs[i], keys[i] = v.tobytes(), key.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in (classes, xs, keys))], ["vec_id", "class", "x", "keys"])

    return vectors.mapInArrow(run, "vec_id long, class binary, x binary, keys binary")


def _cell(rows: list[tuple], table: int, same: bool, threshold: float) -> tuple[list, list]:
    """(vec_id, vectors linked) and forest edges (vec_id, vec_id) of the pairs of a cell that first meet in this table."""
    side = np.array([r[0] for r in rows], np.int64)
    ids = np.array([r[1] for r in rows], np.int64)
    x = np.stack([np.frombuffer(r[2], np.float64) for r in rows])
    keys = np.stack([np.frombuffer(r[3], np.int64) for r in rows])[:, :table]
    weight = np.array([r[4] for r in rows], np.int64)
    left = np.arange(len(rows)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    counts, parent = np.zeros(len(rows), np.int64), list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    if len(left) and len(right):
        close = x[left] @ x[right].T >= threshold - 1e-9
        if same:
            close &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        a, b = np.nonzero(close)
        a, b = left[a], right[b]
        cosine = (x[a] * x[b]).sum(axis=1)
        for i in np.flatnonzero(np.abs(cosine - threshold) < 1e-12):  # the order of a sum must not decide
            cosine[i] = math.fsum(x[a[i]] * x[b[i]])
        a, b = a[cosine >= threshold], b[cosine >= threshold]
        if table:
            new = ~(keys[a] == keys[b]).any(axis=1)
            a, b = a[new], b[new]
        np.add.at(counts, a, weight[b])
        np.add.at(counts, b, weight[a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
                edges.append((int(ids[i]), int(ids[j])))
    return [(int(ids[i]), int(counts[i])) for i in np.flatnonzero(counts)], edges


def links(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, found): vec_id, class, rep, n (the class's least id and its size) of each usable row; and of the reps
    vec_id, n_links (partial counts to be summed), other (the far end of a forest edge, else null)."""
    good = V.usable(vectors)
    k, tables = parameters(good.count(), threshold)
    table = materialize(hashed(good, k, tables))
    several = materialize(table.groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    marked = spread_join(table, several, ["class"], "vec_id", "left").withColumns({"rep": F.coalesce("rep", "vec_id"), "n": F.coalesce("n", F.lit(1).cast("long"))})
    members = materialize(marked.select("vec_id", "class", "rep", "n"))
    first = marked.where("n = 1").unionByName(marked.where("n > 1 AND vec_id = rep").dropDuplicates(["class"]))
    each = first.withColumn("keys_list", F.expr(f"transform(sequence(0, {tables - 1}), i -> substring(keys, i * 8 + 1, 8))"))
    each = each.select("vec_id", "x", "keys", "n", F.posexplode("keys_list").alias("t", "key"))

    def work(key: tuple, same: bool, rows: list[tuple]) -> list[tuple]:
        counts, edges = _cell(rows, key[0], same, threshold)
        return [(i, n, None) for i, n in counts] + [(i, 0, j) for i, j in edges]

    found = materialize(in_cells(each.select("t", "key", "vec_id", "x", "keys", "n"), ["t", "key"], "vec_id", BLOCK, work, ["vec_id", "n_links", "other"]))
    discard(table), discard(several)
    return members, found


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    members, found = links(vectors, threshold)
    parts = components(found.where("other IS NOT NULL").select("vec_id", "other")).withColumnRenamed("id", "rep")
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("vec_id", "rep")
    reps = materialize(counts.join(parts, "rep", "full"))
    # a row whose vector is like no other stays as it is
    linked = spread_join(members, reps, ["rep"], "vec_id", "left")
    n_links = F.coalesce("n_links", F.lit(0).cast("long")) + F.col("n") - 1
    linked = linked.select("vec_id", n_links.alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    rest = vectors.where(~V.is_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
