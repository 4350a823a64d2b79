"""What a named query is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.plans.frames import frame, with_frames


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def adder(queries: dict[str, Query]):
    """A decorator that registers fn(*frames) under a name, with its SQL behind the frames."""

    def query(name: str, *frames: str, sql: str | None = None):
        def put(fn):
            queries[name] = Query(lambda spark, sf_dir: fn(*(frame(spark, sf_dir, f) for f in frames)), with_frames(sql, *frames) if sql else None)
            return fn

        return put

    return query


def r6(*names: str):
    """The columns rounded to 6 places, so that sums in another order compare equal."""
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def joined(name: str) -> F.Column:
    """A list column as text."""
    return F.array_join(name, ",").alias(name)
