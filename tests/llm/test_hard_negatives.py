"""Block products and windows against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import hard_negatives as H

LAST = (1 << 63) - 1


def brute(rows, is_anchor, k=5):
    """rows: (id or None, label, list of whole numbers)."""
    out, key = [], lambda s, i: (-s, LAST if i is None else i)
    for a, (anchor, label, x) in enumerate(rows):
        if anchor is None or not is_anchor(anchor):
            continue
        scores = [(sum(p * q for p, q in zip(x, y)), i, other == label, b) for b, (i, other, y) in enumerate(rows) if len(y) == len(x)]
        same = sorted((s for s in scores if s[2] and s[3] != a), key=lambda s: key(s[0], s[1]))[:k]
        for score, positive, *_ in same:
            window = sorted((s for s in scores if not s[2] and 80 * score <= 100 * s[0] <= 100 * score), key=lambda s: key(s[0], s[1]))[:k]
            out += [(anchor, positive, rank, s[1], score, s[0]) for rank, s in enumerate(window, 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: [LAST if v is None else v for v in r])


@pytest.mark.parametrize("sizes", [(1024, 128, 32), (7, 3, 2), (1, 1, 1)])
def test_equals_brute_force(spark, sizes):
    r = np.random.default_rng(6)
    rows = [(i, int(r.integers(0, 4)), r.integers(-3, 9, 6).tolist()) for i in range(60)]
    rows += [(100, 1, [5, 5, 5, 5, 5, 5])] * 3 + [(200 + i, 2, [5, 5, 5, 5, 5, 5]) for i in range(20)]
    rows += [(None, 1, [6, 5, 5, 5, 5, 5]), (None, 2, [4, 5, 5, 5, 5, 5]), (300, 1, [1, 2]), (301, 1, [2, 2]), (302, 2, [1, 2]), (310, 1, []), (311, 1, []), (312, 3, []), (400, 9, [1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").withColumn("number", F.lit("x")).repartition(3)
    block, anchors, chunk = sizes
    if block == 1:
        rows = [x for x in rows if x[0] is None or x[0] < 25 or x[0] in (100, 300, 301, 302)]
        df = df.where("vec_id IS NULL OR vec_id < 25 OR vec_id IN (100, 300, 301, 302)")
    got = [tuple(x) for x in H.mine(df, F.col("vec_id") % 10 == 0, block=block, anchor_block=anchors, chunk=chunk).collect()]
    assert order(got) == order(brute(rows, lambda i: i % 10 == 0)) and got


def test_rows_that_take_no_part(spark):
    rows = [(100, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.8, 0.5], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (8, [1.0, 0.5], None), (7, [0.9, 0.49], 1), (700, [-0.001, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = H.relabelled(H.quantised(df), 7, 10)
    assert {(r.vec_id, r.label, tuple(r.vector)) for r in q.collect()} == {(100, 1, (256, 128)), (1, 1, (230, 128)), (2, 2, (204, 128)), (7, 2, (230, 125)), (700, 0, (-1, 0))}
    got = [tuple(r) for r in H.mine(q, F.col("vec_id") % 100 == 0).collect()]
    first = 256 * 230 + 128 * 128
    assert sorted(got) == [(100, 1, 1, 7, first, 256 * 230 + 128 * 125), (100, 1, 2, 2, first, 256 * 204 + 128 * 128)]
    assert H.mine(q.limit(0), F.lit(True)).count() == 0
    assert H.mine(q.where("label = 9"), F.lit(True)).count() == 0


def test_products_are_exact(spark):
    r = np.random.default_rng(2)
    for top in (1 << 8, 1 << 26, 1 << 28):
        a, b = (r.integers(-top, top, (5, 33)) for _ in range(2))
        want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
        assert H.product(a, b).tolist() == want
    assert H.product(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2
    df = spark.createDataFrame([(0, 1, [1 << 40]), (1, 1, [1])], "vec_id long, label int, vector array<long>")
    with pytest.raises(Exception, match="too long"):
        H.mine(df, F.col("vec_id") == 0).collect()


def test_ties_go_to_smaller_ids():
    scores, ids = np.array([3, 9, 9, 9, 1, 9, 2, 2, 2, 2, 2]), np.array([1, 9, 4, 7, 2, 3, 5, 6, 8, 10, 11])
    assert ids[H.best(scores, ids, 2)].tolist() == [3, 4] and len(H.best(scores[:0], ids[:0], 2)) == 0


def test_nothing_of_the_grid_is_broadcast(spark):
    """Chunks that pack well were taken for small by a join and went through the driver."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("label"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i % 3 + F.col("id") % 2).alias("vector"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64k")
    try:
        got = H.mine(rows, F.col("vec_id") % 20 == 0, low=0).count()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == 150 * 25


def test_chunks_are_packed_exactly():
    for top in (1, 1 << 15, 1 << 31, 1 << 40):
        x = np.array([[top, -top, 0], [top - 1, 1 - top, 5]])
        assert H._unpacked(H._packed(x), 2).tolist() == x.tolist()
