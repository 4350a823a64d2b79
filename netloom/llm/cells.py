"""Pairs within buckets of any size, without emitting them: blocks against blocks.

A bucket's members are dealt into blocks by a hash of their id; each pair of blocks is a cell of its own, so a hot
bucket becomes many cells of bounded size that any tasks can take. Buckets of one member drop out before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import tidy


def in_cells(members: DataFrame, keys: list[str], id_column: str, block: int, work: Callable, out_names: list[str]) -> DataFrame:
    """work(key, same, rows) for each cell; rows are (side, *other columns). Returns rows of longs.

    In a cell of one block with itself (same) each pair is to be looked at once; else rows of side 0 meet rows of
    side 1. work returns a list of tuples, one value for each of out_names.
    """
    payload = [c for c in members.columns if c not in keys]
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    inside = members.join(sizes, keys).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    inside = inside.withColumn("_own", F.pmod(F.xxhash64(id_column), F.col("_blocks")).cast("int"))
    inside = inside.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    place = [F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")]
    cells = inside.select(*keys, *place, (F.col("_own") > F.col("_other")).cast("int").alias("_side"), *payload)
    head = len(keys) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = [], None, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, out_names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:head] != now:
                    if len(held) > 1:
                        out += work(now[: len(keys)], now[-2] == now[-1], held)
                        if len(out) > 10_000:
                            yield flush()
                    held, now = [], row[:head]
                held.append(row[head:])
        if len(held) > 1:
            out += work(now[: len(keys)], now[-2] == now[-1], held)
        if out:
            yield flush()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [*keys, "_i", "_j"]
    return cells.repartition(parts, *at).sortWithinPartitions(*at).mapInArrow(tidy(run), ", ".join(f"{n} long" for n in out_names))
