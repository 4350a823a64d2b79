"""Shared plumbing of the training-data operators: tables, shared storage, bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the place all executors share (spark.checkpoint.dir).

    Only where that setting is absent and everything runs in one process, as in tests, a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/netloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet to the shared folder and reads them again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    if before is not None:  # the rows are safe in the shared folder: the shuffle files behind them can go at once
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files behind a materialized table that is no longer needed."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/netloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys go to all executors up to so many rows.
MAX_KEYS, SALTS, HOTTEST = 500_000, 16, 4096


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], spread: str, how: str = "left_semi") -> DataFrame:
    """Joins rows with keys (a materialized table with one row a key). One key may hold any share of the rows.

    Few keys are broadcast, after a count. Else the rows of a key are dealt over SALTS tasks by a hash of the column
    `spread`, and each key goes to all of them.
    """
    if keys.count() <= MAX_KEYS:
        return rows.join(F.broadcast(keys), on, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def counted_join(rows: DataFrame, counted: DataFrame, on: list[str], spread: str, how: str, *carried) -> DataFrame:
    """Joins rows with counted (a materialized table of keys with _n, the rows of each) and its columns `carried`.

    One key may hold any share of the rows: keys that hold a HOTTEST-th of the rows or more, HOTTEST at most, go to all
    executors, and their rows are dealt over SALTS tasks by a hash of the column `spread`.
    """
    least = max(2, (counted.agg(F.sum("_n")).first()[0] or 0) // HOTTEST + 1)
    hot = F.broadcast(counted.where(F.col("_n") >= least).select(*on, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.when(F.col("_n") >= least, F.lit(SALTS - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    dealt = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    return dealt.join(counted.select(*on, F.explode(every).alias("_salt"), *carried), [*on, "_salt"], how).drop("_salt")


def repeated(rows: DataFrame, on: list[str], spread: str) -> DataFrame:
    """The rows whose key occurs more than once. Counts come from partial aggregates."""
    counted = materialize(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    return counted_join(rows, counted, on, spread, "left_semi")


def freed() -> None:
    """Gives back to the system what Arrow and the C library hold without use."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def tidy(run: Callable) -> Callable:
    """The same function of batches, for mapInArrow. A Python worker lives on beside the JVM when its task has ended:
    memory that it holds without use is given back before and after."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        yield from run(batches)
        freed()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python objects of few texts live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        freed()


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, pa.Table]]:
    """The rows of each run of equal keys, which are the first columns and hold no nulls."""
    held, now = [], None
    for batch in batches:
        n = batch.num_rows
        edges = []
        for k in range(keys if n > 1 else 0):
            column = batch.column(k)
            edges += (pc.indices_nonzero(pc.not_equal(column.slice(1), column.slice(0, n - 1))).to_numpy() + 1).tolist()
        starts = [0, *sorted(set(edges))] if n else []
        for a, b in zip(starts, [*starts[1:], n], strict=False):
            key = [batch.column(k)[a].as_py() for k in range(keys)]
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


class TwoGenerations(dict):
    """A dict whose older half of entries is dropped when it holds too many."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def fraction_of(df: DataFrame, key: str, wanted: int) -> tuple[DataFrame, int]:
    """About `wanted` rows of df chosen by a hash of the key (all rows if there are fewer), and the row count."""
    n = df.count()
    if n <= wanted:
        return df, n
    return df.where(F.pmod(F.xxhash64(F.lit(7919), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * wanted / n)), n
