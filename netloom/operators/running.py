"""Cumulative sums and exact quantiles over an order of all rows, without one task that sees all of them.

Rows are cut into ranges of the order, the more the more rows there are. Sums run within a range, and a table of a row
for each range and key in it carries the sums of the ranges before. Any imbalance of the cuts changes the speed only,
never a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.staged import staged

#: Rows of a range on average.
ROWS = 500_000


def positions(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with its rows' places in the order, from 0: ranges of the order are written once, numbered on their own, and
    moved on by the rows of the ranges before. Only rows that are equal in all of `order` share a range by force. There
    are more ranges with more rows, so that what a task holds does not grow with df."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-df.count() // ROWS))
    ranged = staged(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    ranged = ranged.repartition(parts, "_range") if parts > least else ranged
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_within", rank).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")


def running(df: DataFrame, keys: list[str], order: str, sums: list[str], buckets: int = 1) -> DataFrame:
    """df with upto_<c> (sum of c over rows up to this one in the order) and all_<c> for each c of sums, within the keys.

    The order must be a number and, within the keys, tell rows apart. Ranges of (keys, order) of about
    ROWS rows, `buckets` of them at least, are summed on their own, so that what a task holds does not grow with df.
    """
    held = staged(df)
    parts = max(buckets, -(-held.count() // ROWS))
    ranged = staged(held.repartitionByRange(parts, *keys, order).withColumn("_range", F.spark_partition_id())) if parts > 1 else held.withColumn("_range", F.lit(0))
    by = ["_range", *keys]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = ranged.groupBy(*by).agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    carried = totals.select(*(F.col(c).alias(f"_k_{c}") for c in by), *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_p_{c}") for c in sums), *(F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums))
    within = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = ranged.repartition(parts, "_range") if parts > 1 else ranged
    inner = dealt.select("*", *(F.sum(c).over(within).alias(f"_w_{c}") for c in sums))
    same = F.col("_range") == F.col("_k__range")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = inner.join(carried, same)
    return out.select(*df.columns, *((F.col(f"_w_{c}") + F.col(f"_p_{c}")).alias(f"upto_{c}") for c in sums), *(f"all_{c}" for c in sums))


def quantiles(df: DataFrame, keys: list[str], x: str, at: dict[str, float], weight: str | None = None) -> DataFrame:
    """keys, n and a column for each quantile, exact and linear between neighbours; nulls do not count. A row stands for `weight` rows."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    run = running(counts, keys, "_x", ["n"])
    value = lambda rank: F.min(F.when(F.col("upto_n") > rank, F.col("_x")))
    columns = []
    for name, q in at.items():
        place = (F.col("all_n") - 1) * q
        columns += [value(F.floor(place)).alias(f"_lo_{name}"), value(F.ceil(place)).alias(f"_hi_{name}")]
    out = run.groupBy(*keys).agg(F.max("all_n").alias("n"), *columns)
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    line = {k: F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * part(q) for k, q in at.items()}
    return out.select(*keys, "n", *(c.alias(k) for k, c in line.items()))
