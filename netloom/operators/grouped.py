"""A function of each group of rows, without a data frame for every group.

Groups are dealt by a hash of their keys and sorted; a task walks its Arrow batches and hands the columns of each group
to the function as numpy arrays. A group stands in memory of one task, so callers keep groups bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def in_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """work(key, columns) -> rows, for each group of df by keys (null keys are a group too), its rows in `order`."""
    rest = [c for c in df.columns if c not in keys]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow = to_arrow_schema(SparkSession.active().createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, out = None, []

        def done() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            out.extend(work(now, {c: table.column(c).to_numpy() for c in rest}))

        for batch in batches:
            n = batch.num_rows
            edges = {0} if n else set()
            for k in range(len(keys) if n > 1 else 0):
                a, b = batch.column(k).slice(1), batch.column(k).slice(0, n - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                edges.update((np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist())
            starts = sorted(edges)
            for at, to in zip(starts, [*starts[1:], n], strict=False):
                key = tuple(batch.column(k)[at].as_py() for k in range(len(keys)))
                if key != now and held:
                    done()
                    held.clear()
                now = key
                held.append(batch.slice(at, to - at))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], arrow.names)
                out.clear()
        if held:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], arrow.names)

    # by one hash of the keys: rows that lie by the keys themselves after a join would not be dealt again, and where that
    # join turns into a broadcast at run time they lie by nothing
    rows = df.select(*keys, *rest).repartition(parts, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, schema)
