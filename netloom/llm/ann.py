"""Approximate nearest neighbours: a forest of random-projection trees searched through a shared priority queue.

The trees are grown on a bounded sample (SAMPLE vectors, chosen by a hash of the id): each node splits its sample at
the median of the projection on the difference of two of its vectors. Every vector is then indexed: each tree gives
it a leaf, and a row with its rounded coordinates (2 bytes each) goes there. A query keeps one priority queue over all
trees, ordered by the largest margin crossed on the way to a node. It opens leaves until they hold the SEARCH share of
the sample in total over the trees, or until the margin exceeds its distance to the k-th nearest vector of the sample,
behind which no leaf can hold a nearer one; it is sent to these leaves only. Large leaves are cut into blocks of
vectors and of queries. A cell sends on the nearest by rounded coordinates with all that rounding could hide, and none
that the sample's vectors in the opened leaves already beat; what is left of these over all cells is reranked by exact
cosine in double precision.

Copies of one vector: only as many of least id as can be answers take part, which loses none. Rows: vectors
that are null, zero or hold null or non-finite components take no part; vectors of different lengths are searched
apart; an id with several different vectors counts by the nearest of them; repeated rows count once; a null vec_id
takes no part; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import vectors as V
from netloom.llm.common import discard, fraction_of, materialize

SAMPLE, TREES, LEAF, SEARCH = 20_000, 12, 32, 1.3
VECTORS_A_BLOCK, QUERIES_A_BLOCK = 4096, 1024
#: More than the cosine of two rounded unit vectors can be wrong by (half precision: 2**-11 of each length).
ROUNDING = 1.2e-3
ANSWERS = "query_id long, rank int, vec_id long, score double"


class Forest:
    """Trees as arrays: node i has children 2i+1 and 2i+2; all leaves lie at one depth."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF):
        random = np.random.default_rng(40_009)
        n, dim = sample.shape
        self.sample, self.sample_leaves = sample, np.zeros((n, trees), np.int32)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        inner = 2**self.depth - 1
        self.directions = random.standard_normal((trees, inner, dim))
        self.cuts = np.zeros((trees, inner))
        self.leaf_share = np.zeros((trees, 2**self.depth))
        for t in range(trees):
            node = np.zeros(n, np.int64)
            for i in range(inner):
                mine = np.flatnonzero(node == i)
                if len(mine) > 1:
                    a, b = random.choice(mine, 2, replace=False)
                    if (sample[a] != sample[b]).any():
                        self.directions[t, i] = sample[a] - sample[b]
                self.directions[t, i] /= np.linalg.norm(self.directions[t, i])
                heights = sample[mine] @ self.directions[t, i]
                self.cuts[t, i] = np.median(heights) if len(mine) else 0.0
                node[mine] = 2 * i + 1 + (heights > self.cuts[t, i])
            self.leaf_share[t] = np.bincount(node - inner, minlength=2**self.depth) / max(n, 1)
            self.sample_leaves[:, t] = node - inner + (t << self.depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, counted through over the trees."""
        out = np.empty((len(x), len(self.cuts)), np.int64)
        for t in range(len(self.cuts)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((x * self.directions[t, node]).sum(axis=1) > self.cuts[t, node])
            out[:, t] = node - (2**self.depth - 1) + (t << self.depth)
        return out

    def opened(self, q: np.ndarray, share: float, k: int) -> tuple[list[int], float]:
        """Leaves that a query opens, nearest margins first, and a cosine that its k nearest there do not fall below."""
        trees, inner = len(self.cuts), 2**self.depth - 1
        gaps = (self.directions @ q - self.cuts).tolist()
        shares = self.leaf_share.tolist()
        far = np.sort(((self.sample - q) ** 2).sum(axis=1))
        # the query itself may be in the sample, so one more; rounding must not shut a leaf
        reach = float(np.sqrt(far[k])) + 1e-6 if len(far) > k else np.inf
        out, had = [], 0.0
        queue = [(0.0, t, 0) for t in range(trees)]
        while queue and had < share:
            margin, t, node = heapq.heappop(queue)
            if margin > reach:
                break
            while node < inner:
                gap = gaps[t][node]
                near = 2 * node + 1 + (gap > 0)
                heapq.heappush(queue, (max(margin, abs(gap)), t, 4 * node + 3 - near))
                node = near
            out.append((t << self.depth) + node - inner)
            had += shares[t][node - inner]
        known = np.zeros(trees << self.depth, bool)
        known[out] = True
        cosines = self.sample[known[self.sample_leaves].any(axis=1)] @ q
        return out, float(np.partition(cosines, len(cosines) - k - 1)[len(cosines) - k - 1]) if len(cosines) > k else -1.0


def _rounded(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in x.astype(np.float16)]


def _nearest(mine: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Of each query of a cell the vectors that can be among its k nearest here, by rounded coordinates."""
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if mine.num_rows and asked.num_rows:
        ids, query_ids = mine.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
        x, q = (np.frombuffer(b"".join(t.column("x").to_pylist()), np.float16).reshape(t.num_rows, -1).astype(np.float32) for t in (mine, asked))
        for query_id, bound, scores in zip(query_ids.tolist(), asked.column("least").to_pylist(), q @ x.T, strict=True):
            scores[ids == query_id] = -2
            least = bound - ROUNDING
            if len(scores) > k:
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k] - 2 * ROUNDING)
            at = np.flatnonzero((scores >= least) & (scores > -1.5))
            out[0].append(np.full(len(at), query_id)), out[1].append(ids[at]), out[2].append(scores[at].astype(np.float64))
    return pa.table([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "about"])


def _cells(rows: DataFrame, plan: DataFrame, id_column: str, own: str, other: str) -> DataFrame:
    """Rows with their block of the leaf, once for each block of the other side."""
    placed = rows.join(F.broadcast(plan), "leaf").withColumn(own, F.pmod(F.xxhash64(id_column), F.col(f"{own}_blocks")))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1))).drop("v_blocks", "q_blocks")


def candidates(base: DataFrame, q_rows: DataFrame, forest: Forest, k: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_id, vec_id, about) of the opened leaves' nearest; the index (leaf, vec_id) and the opened leaves (leaf, query_id)."""
    shared = base.sparkSession.sparkContext.broadcast(forest)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = V.unit(np.stack(V.matrix(part.column(1))))
                leaf = shared.value.leaves(x)
                trees = leaf.shape[1]
                rows = [r for r in _rounded(x) for _ in range(trees)]
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), trees)), pa.array(rows, pa.binary())], ["leaf", "vec_id", "x"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                x = V.unit(np.stack(V.matrix(part.column(1))))
                opened, least = zip(*(shared.value.opened(q, share, k) for q in x), strict=True)
                sizes = np.array(list(map(len, opened)))
                rows = [r for r, n in zip(_rounded(x), sizes.tolist(), strict=True) for _ in range(n)]
                columns = (np.concatenate(opened).astype(np.int64), np.repeat(part.column(0).to_numpy(), sizes), np.repeat(np.array(least), sizes))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(rows, pa.binary())], ["leaf", "query_id", "least", "x"])

    # of equal vectors the k + 1 least ids are enough: the others come after them in every ranking
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    targets = base.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("vec_id", "embedding")
    asked = materialize(q_rows.mapInArrow(ask, "leaf long, query_id long, least double, x binary"))
    opened = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES_A_BLOCK).alias("q_blocks"))
    # no more leaves than the forest of the sample has
    indexed = materialize(targets.mapInArrow(index, "leaf long, vec_id long, x binary").join(F.broadcast(opened.select("leaf")), "leaf", "left_semi"))
    plan = materialize(indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / VECTORS_A_BLOCK).alias("v_blocks")).join(opened, "leaf"))
    left, right = _cells(indexed, plan, "vec_id", "v", "q"), _cells(asked, plan, "query_id", "q", "v")

    def cell(mine: pa.Table, there: pa.Table) -> pa.Table:
        return _nearest(mine, there, k)

    key = ["leaf", "v", "q"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "query_id long, vec_id long, about double"), indexed, asked


def _search(good: DataFrame, dim: int, queries: F.Column, k: int, share: float, trees: int) -> DataFrame:
    """search() over the usable vectors of one length."""
    good = good.where(F.size("embedding") == dim)
    sample = [np.asarray(r.embedding, np.float64) for r in fraction_of(good, "vec_id", SAMPLE)[0].limit(2 * SAMPLE).collect()]
    forest = Forest(V.unit(np.stack(sample)) if sample else np.zeros((0, dim)), trees)
    base = materialize(good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).distinct())
    found, indexed, asked = candidates(base, base.where(queries), forest, k, share)
    found = materialize(found.groupBy("query_id", "vec_id").agg(F.max("about").alias("about")))
    discard(indexed), discard(asked)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about")))
    least = found.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query_id").agg(F.min("about").alias("least"))
    close = found.join(least, "query_id").where(F.col("about") >= F.col("least") - 2 * ROUNDING).select("query_id", "vec_id")
    pairs = close.join(base, "vec_id").join(base.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, q = (V.unit(np.stack(V.matrix(batch.column(i)))) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x * q).sum(axis=1))], ["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "vec_id", "embedding", "q").mapInArrow(exact, "query_id long, vec_id long, score double")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: F.Column, k: int = 5, share: float = SEARCH, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that `queries` selects by vec_id, itself excluded."""
    good = V.usable(vectors)
    lengths = sorted(r.n for r in good.select(F.size("embedding").alias("n")).distinct().collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], ANSWERS)
    return reduce(DataFrame.union, [_search(good, n, queries, k, share, trees) for n in lengths])


def brute_force(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int = 5) -> list[list[int]]:
    """Exact answers, for measuring recall."""
    x = V.unit(x)
    out = []
    for i in queries:
        scores = x @ x[i]
        order = np.lexsort((ids, -scores))
        out.append([int(ids[j]) for j in order if j != i][:k])
    return out
