"""Model scoring inside the plan: array expressions for small heads, batches of rows for networks, MITRE-style mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S


class Network:
    """Dense layers with ReLU between; a classifier head and an autoencoder as numpy weights."""

    def __init__(self, classifier: list[tuple[np.ndarray, np.ndarray]], autoencoder: list[tuple[np.ndarray, np.ndarray]]):
        self.classifier, self.autoencoder = classifier, autoencoder

    @staticmethod
    def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        for i, (w, b) in enumerate(layers):
            x = x @ w + b
            if i + 1 < len(layers):
                x = np.maximum(x, 0)
        return x

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class number, its probability, and the mean squared reconstruction error of each row."""
        z = self.forward(x, self.classifier)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        error = ((x - self.forward(x, self.autoencoder)) ** 2).mean(axis=1)
        return p.argmax(axis=1), p.max(axis=1), error


def score_batches(df: DataFrame, key: str, features: list[str], network: Network, classes: list[str], batch: int = 512) -> DataFrame:
    """key, classifier_class, max_prob, ae_score: the network over batches of rows; its weights are broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(network)
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                label, prob, error = shared.value.scores(part[features].to_numpy(np.float32))
                yield pd.DataFrame({key: part[key], "classifier_class": [classes[i] for i in label], "max_prob": prob.astype(float), "ae_score": error.astype(float)})

    plain = df.select(key, *(S.finite(F.col(f)).alias(f) for f in features))
    return plain.mapInPandas(run, f"{key} {kind}, classifier_class string, max_prob double, ae_score double")


def hybrid_learner(df: DataFrame, label: str, ae: str = "ae_score", prob: str = "max_prob") -> tuple[tuple[float, float], float]:
    """Weights and intercept of a balanced logistic learner on (ae, 1 - max_prob)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not 0 < counts.p < counts.n:
        raise ValueError("the learner needs both classes")
    weight = F.when(F.col(label) == 1, counts.n / (2.0 * counts.p)).otherwise(counts.n / (2.0 * (counts.n - counts.p)))
    rows = df.select(F.col(label).cast("double").alias("label"), F.col(ae).alias("a"), (1 - F.col(prob)).alias("s"), weight.alias("w"))
    model = LogisticRegression(weightCol="w", regParam=1e-6, maxIter=200).fit(VectorAssembler(inputCols=["a", "s"], outputCol="features").transform(rows))
    return (float(model.coefficients[0]), float(model.coefficients[1])), float(model.intercept)


def ranked_techniques(evidence: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """keys, technique, confidence, rank: of several proofs of a technique the strongest counts; then the best ones.

    evidence: keys, technique, confidence.
    """
    best = evidence.groupBy(*keys, "technique").agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "technique"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)


def stratified_weights(df: DataFrame, label: str) -> DataFrame:
    """df with the sampling weight that makes each class equally likely."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, label).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def resampled(df: DataFrame, weight: str, n: int, key: str, seed: int = 3) -> DataFrame:
    """About n rows drawn with replacement by weight: each row comes Poisson(n w / W) times, by a hash of its key."""
    total = df.agg(F.sum(weight).alias("_W"))
    rate = F.col(weight) / F.col("_W") * n
    # a rate is a sum of equal parts of at most 16, each with a draw of its own: 64 terms hold all of its distribution
    parts = F.greatest(F.ceil(rate / 16), F.lit(1))
    part = rate / parts

    def draw(i: F.Column) -> F.Column:
        u = (F.pmod(F.when(i == 1, F.xxhash64(F.lit(seed), key)).otherwise(F.xxhash64(F.lit(seed), key, i)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        # the inverse of the Poisson distribution, summed term by term
        state = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("c"), F.lit(0).alias("k"))
        step = lambda s, j: F.when(s["c"] >= u, s).otherwise(F.struct((s["p"] * part / j).alias("p"), (s["c"] + s["p"] * part / j).alias("c"), (s["k"] + 1).alias("k")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), state, step)["k"]

    times = F.aggregate(F.sequence(F.lit(1).cast("long"), parts), F.lit(0).cast("long"), lambda n, i: n + draw(i))
    return df.crossJoin(F.broadcast(total)).withColumn("_t", times).where("_t > 0").withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_t")))).drop("_t", "_c", "_W")
