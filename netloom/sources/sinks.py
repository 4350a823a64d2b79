"""Writers: scores and splits as CSV, canonical JSON lines, reports, and files that never change."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.staged import released, staged


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header, a folder for each value of `by`."""
    writer = df.write.option("header", True).mode("overwrite")
    (writer.partitionBy(by) if by else writer).csv(path)


def canonical_json(df: DataFrame) -> DataFrame:
    """line: a JSON object a row with its keys in order; -0 is written as 0."""
    return df.select(F.to_json(_canonical(df), {"ignoreNullFields": "false"}).alias("line"))


def _canonical(df: DataFrame) -> Column:
    plain = lambda c, kind: F.when(F.col(f"`{c}`") == 0, F.lit(0.0)).otherwise(F.col(f"`{c}`")) if kind in ("double", "float") else F.col(f"`{c}`")
    return F.struct(*(plain(c, k).alias(c) for c, k in sorted(df.dtypes)))


def content_hash(df: DataFrame) -> str:
    """SHA-256 of the set of rows, whatever their order: rows are hashed in buckets, the buckets' hashes once more."""
    hashed = canonical_json(df).select(F.sha2("line", 256).alias("h"))
    parts = hashed.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("p"))
    row = parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "p"))), ","), 256).alias("d")).first()
    return row.d


#: Rows of a range whose lines are hashed together, and ranges of a hash of hashes.
RANGE = 4096


def ordered_hash(df: DataFrame, order: list[str]) -> str:
    """SHA-256 of the rows in their order: ranges of RANGE rows by position are hashed, then ranges of those hashes, up to one.

    Positions come from sorted ranges of the table and the counts of the ranges before, so that no task sees more than
    its share, and how rows are partitioned changes nothing. Rows that are equal in `order` go by their canonical line;
    equal lines are one with their number. An empty table has the hash of no bytes.
    """
    lines = df.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.to_json(_canonical(df), {"ignoreNullFields": "false"}).alias("line"))
    by = [f"_o{i}" for i in range(len(order))]
    runs = lines.groupBy(*by, "line").agg(F.count(F.lit(1)).alias("n")).select(*by, F.sha2("line", 256).alias("line"), "n")
    placed = staged(runs.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "line").withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))  # a row a partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*by, "line")) - 1
    level = placed.join(F.broadcast(before), "_p").select((F.col("_before") + rank).alias("place"), F.concat_ws("x", "line", F.col("n").cast("string")).alias("h"))
    total = level.count()
    while total > 1:
        inside = F.array_sort(F.collect_list(F.struct("place", "h")))
        level = level.groupBy(F.floor(F.col("place") / RANGE).alias("place")).agg(F.sha2(F.array_join(F.transform(inside, lambda s: s["h"]), ","), 256).alias("h"))
        total = -(-total // RANGE)
    row = level.first()
    released(placed)
    return hashlib.sha256(row.h.encode() if row else b"").hexdigest()


def write_once(df: DataFrame, path: str) -> bool:
    """Writes JSON lines where nothing is yet; the same content again does nothing, other content raises."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        there = spark.read.text(path).select(F.sha2("value", 256).alias("h"))
        new = canonical_json(df).select(F.sha2("line", 256).alias("h"))
        if there.exceptAll(new).limit(1).count() or new.exceptAll(there).limit(1).count():
            raise ValueError(f"{path} holds other content")
        return False
    canonical_json(df).write.mode("errorifexists").text(path)
    return True
