"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a join with partial minima; no group of links meets in one task, nothing is collected but counts.

Rows: links with a null end are left out, links of an id with itself make it a component of one, repeated links count
once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row.n, row.h


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of its neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: two long columns. Returns id, component_id (least id reachable) of every id that has a link to another.

    Null ends and links to oneself are ignored; repeated links and either direction make no difference.
    """
    a, b = links.columns
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        new = materialize(_small_star(_large_star(edges)))
        after = _state(new)
        discard(edges)
        edges = new
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
