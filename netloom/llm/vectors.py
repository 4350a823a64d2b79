"""What the operators on embeddings share: which vectors count, and cosines in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_usable() -> F.Column:
    """Whether a row has an id and a vector that is not null, empty or zero and has finite components only; never null."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(x, lambda v: v != 0.0)
    return F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite & some, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the usable rows."""
    return vectors.where(is_usable()).select("vec_id", "embedding")


def matrix(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column in double precision."""
    return [np.asarray(v, np.float64) for v in column.to_pylist()]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
