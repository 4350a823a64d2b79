"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text (lengths, character classes, word and line repetition, entropy) are binned;
trees are grown on gradient histograms, level by level, and flattened into arrays, so that scoring is a
vectorised walk of all rows through all trees. Trained on the driver from a bounded sample of labelled rows
(TRAIN_ROWS); scoring covers every row.

Rows: a null or empty text has all statistics zero and is scored like any other; a label that is null, or whose
document is absent, teaches nothing; without two classes of labels every score is the share of label 1 (0.5
without labels); a document with several labels teaches each of them; repeated rows score alike; texts of any length
are read whole; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import library_tokens
from netloom.llm.common import slices, tidy

#: At most so many labelled rows are learnt from, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 80, 4, 0.15, 1.0, 8

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digit", "space", "punct", "exclaim", "question", "comma", "stop", "high", "control",
    "byte_entropy", "distinct_words", "distinct_pairs", "top_word", "top3_words", "short_words", "long_words", "repeat_next",
    "lines_per_word", "distinct_lines", "top_line_bytes", "mean_line", "short_lines", "sentence_words", "longest_word", "hapax",
)

_CLASS = np.zeros(256, np.int64)
for _c, _bytes in enumerate((range(65, 91), range(48, 58), (32, 9, 10, 13), b"\"#$%&'()*+-/:;<=>@[\\]^_`{|}~", b"!", b"?", b",", b".", range(128, 256)), 1):
    _CLASS[list(_bytes)] = _c
_CLASS[[b for b in range(32) if b not in (9, 10, 13)] + [127]] = 10


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    classes = np.bincount(_CLASS, counts, 11) / n
    words = raw.split()
    m = max(1, len(words))
    seen = Counter(words)
    top = seen.most_common(3)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    k = max(1, len(lines))
    by_line = Counter(lines)
    line, times = by_line.most_common(1)[0] if lines else (b"", 0)
    return [
        np.log1p(n), np.log1p(len(words)), n / m, *classes[1:11].tolist(),
        float(-(share * np.log2(share)).sum()), len(seen) / m, len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1), top[0][1] / m if top else 0.0, sum(c for _, c in top) / m,
        float((sizes <= 3).sum() / m), float((sizes >= 12).sum() / m), sum(map(eq, words, words[1:])) / m,
        k / m, len(by_line) / k, len(line) * times / n if times > 1 else 0.0, n / k, sum(len(x) < 40 for x in lines) / k,
        m / (1 + int(counts[46])), float(sizes.max()) if len(sizes) else 0.0, list(seen.values()).count(1) / m,
    ]


@dataclass
class Forest:
    """Flattened trees: node i has children 2i+1 and 2i+2; a node without a split passes rows to the left."""

    edges: np.ndarray  # features x (BINS - 1)
    feature: np.ndarray  # trees x nodes
    bin: np.ndarray
    leaf: np.ndarray  # trees x 2**DEPTH
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        binned = binning(x, self.edges)
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, at, leaf in zip(self.feature, self.bin, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > at[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def binning(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)


def train(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosts on the logistic loss. Rows in any order give the same trees up to rounding."""
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    nodes, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((width, BINS - 1)), np.zeros((0, nodes), np.int64), np.zeros((0, nodes), np.int64), np.zeros((0, leaves)), base)
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    binned = binning(x, edges)
    flat = binned + np.arange(width)[None, :] * BINS
    total = np.full(n, base)
    features, bins, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, at = np.zeros(nodes, np.int64), np.full(nodes, BINS, np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            keys = (((node - first) * width * BINS)[:, None] + flat).ravel()
            size = count * width * BINS
            g, h, c = (np.bincount(keys, np.repeat(v, width), size).reshape(count, width, BINS) for v in (gradient, weight, np.ones(n)))
            gl, hl, cl = (v.cumsum(axis=2)[:, :, :-1] for v in (g, h, c))
            gt, ht, ct = (v.sum(axis=2, keepdims=True) for v in (g, h, c))
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(cl < LEAST) | (ct - cl < LEAST)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            f, b = best // (BINS - 1), best % (BINS - 1)
            feature[first : first + count] = np.where(good, f, 0)
            at[first : first + count] = np.where(good, b, BINS)
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > at[node])
        slot = node - nodes
        leaf = RATE * np.bincount(slot, gradient, leaves) / (np.bincount(slot, weight, leaves) + L2)
        total += leaf[slot]
        features.append(feature)
        bins.append(at)
        values.append(leaf)
    return Forest(edges, np.array(features), np.array(bins), np.array(values), base)


def statistics_frame(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of the FEATURES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_tokens.dropped()
        for batch in slices(batches):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, x array<double>")


def held_out() -> F.Column:
    """crc32(doc_id as text) mod 3 = 1: rows no label is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Forest:
    """Trains on at most train_rows labelled rows outside the held-out fold."""
    usable = labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    chosen = usable.orderBy(F.xxhash64(F.lit(7919), "doc_id"), "doc_id", "y").limit(train_rows)  # bounded: sent to all executors
    lessons = statistics_frame(docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"))
    rows = lessons.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "y").limit(2 * train_rows).collect()
    return train(np.array([r.x for r in rows], np.float64), np.array([r.y for r in rows], np.float64))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_tokens.dropped()
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def accepted(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least so much. One pass, no shuffle."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_tokens.dropped()
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column(place).to_pylist()], np.float64)
            yield batch.filter(pa.array(forest.scores(x) >= least))

    return docs.mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
