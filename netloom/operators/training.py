"""Training of the flow classifier and its autoencoder in synchronous gradient rounds.

The weights go to all executors; each partition walks its rows in chunks and gives the sum of its chunks' gradients as
one vector; vectors are added in two levels and the driver takes one step. What the driver holds is a few vectors of
the size of the weights, whatever the rows. A round reads all rows, or a share of them chosen by a hash of key and round.

The network: a projection, residual blocks, a linear head for the classes, a small projection head for the contrastive
loss, and an autoencoder beside them. The loss of a chunk is the focal loss (smoothed labels, class weights, a factor
for confusions of one pair of classes), `contrast` times the supervised contrastive loss on the chunk, and half the mean
squared reconstruction error. There is no dropout, so that a round is a function of weights and rows.

Rows with a null label or without all features do not train; a label outside the classes raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shape of the losses.
SMOOTH, TEMPERATURE, PAIR_PENALTY, NEGATIVE_WEIGHT, NEGATIVE_TOP, NEGATIVE_MARGIN, RECONSTRUCTION = 0.05, 0.15, 2.0, 0.20, 64, 0.20, 0.5


@dataclass(frozen=True)
class Shape:
    features: int
    classes: int
    hidden: int = 64
    blocks: int = 3
    ae_hidden: int = 32
    projection: tuple[int, int] = (128, 64)
    gamma: float = 2.0
    contrast: float = 0.3
    weights: tuple[float, ...] = ()
    pair: tuple[int, int] | None = None
    chunk: int = 512

    def layers(self) -> dict[str, tuple[int, ...]]:
        """Name and shape of every weight, in a fixed order."""
        out: dict[str, tuple[int, ...]] = {}

        def dense(name: str, a: int, b: int, norm: bool = False) -> None:
            out[f"{name}.w"], out[f"{name}.b"] = (a, b), (b,)
            if norm:
                out[f"{name}.g"], out[f"{name}.s"] = (b,), (b,)

        h, m = self.hidden, self.ae_hidden
        dense("in", self.features, h, True)
        for i in range(self.blocks):
            dense(f"r{i}a", h, h, True)
            dense(f"r{i}b", h, h, True)
        dense("head", h, self.classes)
        dense("p0", h, self.projection[0])
        dense("p1", *self.projection)
        for i, (a, b) in enumerate([(self.features, 2 * m), (2 * m, m), (m, m // 2), (m // 2, m), (m, 2 * m), (2 * m, self.features)]):
            dense(f"ae{i}", a, b)
        return out


def start(shape: Shape, seed: int = 42) -> np.ndarray:
    random, parts = np.random.default_rng(seed), []
    for name, size in shape.layers().items():
        kind = name[-1]
        bound = 1 / np.sqrt(size[0])
        parts.append(random.uniform(-bound, bound, size).ravel() if kind == "w" else np.full(size, float(kind == "g")))
    return np.concatenate(parts)


def named(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in shape.layers().items():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


_C = np.sqrt(2 / np.pi)


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value (tanh form) and its slope."""
    t = np.tanh(_C * (x + 0.044715 * (x * x * x)))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * _C * (1 + 3 * 0.044715 * x * x)


class Pass:
    """One chunk forward and back: the slopes of the weights are added into `grad`."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.w = shape, named(shape, flat)
        self.grad = np.zeros_like(flat)
        self.g = named(shape, self.grad)

    def dense(self, name: str, x: np.ndarray):
        y = x @ self.w[f"{name}.w"] + self.w[f"{name}.b"]

        def back(dy: np.ndarray) -> np.ndarray:
            self.g[f"{name}.w"] += x.T @ dy
            self.g[f"{name}.b"] += dy.sum(axis=0)
            return dy @ self.w[f"{name}.w"].T

        return y, back

    def normed(self, name: str, x: np.ndarray):
        """Dense and a norm over the row."""
        y, dense_back = self.dense(name, x)
        mean, spread = y.mean(axis=1, keepdims=True), np.sqrt(y.var(axis=1, keepdims=True) + 1e-5)
        u = (y - mean) / spread

        def back(dz: np.ndarray) -> np.ndarray:
            self.g[f"{name}.g"] += (dz * u).sum(axis=0)
            self.g[f"{name}.s"] += dz.sum(axis=0)
            du = dz * self.w[f"{name}.g"]
            return dense_back((du - du.mean(axis=1, keepdims=True) - u * (du * u).mean(axis=1, keepdims=True)) / spread)

        return u * self.w[f"{name}.g"] + self.w[f"{name}.s"], back

    def backbone(self, x: np.ndarray):
        backs = []
        y, back = self.normed("in", x)
        h, slope = gelu(y)
        backs.append(lambda d, back=back, slope=slope: back(d * slope))
        for i in range(self.shape.blocks):
            a, a_back = self.normed(f"r{i}a", h)
            b, b_slope = gelu(a)
            c, c_back = self.normed(f"r{i}b", b)
            h, slope = gelu(h + c)

            def block(d: np.ndarray, a_back=a_back, b_slope=b_slope, c_back=c_back, slope=slope) -> np.ndarray:
                d = d * slope
                return d + a_back(c_back(d) * b_slope)

            backs.append(block)

        def back_all(d: np.ndarray) -> None:
            for back in reversed(backs):
                d = back(d)

        return h, back_all

    def chain(self, names: list[str], x: np.ndarray):
        """Dense layers with gelu between them."""
        backs = []
        for i, name in enumerate(names):
            x, back = self.dense(name, x)
            slope = 1.0
            if i + 1 < len(names):
                x, slope = gelu(x)
            backs.append(lambda d, back=back, slope=slope: back(d * slope))

        def back_all(d: np.ndarray) -> np.ndarray:
            for back in reversed(backs):
                d = back(d)
            return d

        return x, back_all

    def loss(self, x: np.ndarray, y: np.ndarray, slopes: bool = True) -> dict[str, float]:
        """total, focal, contrast and reconstruction loss of the chunk; slopes of the total go into grad."""
        shape = self.shape
        h, h_back = self.backbone(x)
        logits, head_back = self.dense("head", h)
        focal, d_logits = focal_loss(logits, y, shape)
        z, p_back = self.chain(["p0", "p1"], h)
        length = np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)
        e = z / length
        con, d_e = contrastive_loss(e, y, shape.pair, slopes)
        again, ae_back = self.chain([f"ae{i}" for i in range(6)], x)
        rest = again - x
        ae = float((rest**2).mean())
        if slopes:
            d_z = shape.contrast * (d_e - e * (d_e * e).sum(axis=1, keepdims=True)) / length
            h_back(head_back(d_logits) + p_back(d_z))
            ae_back(RECONSTRUCTION * 2 * rest / rest.size)
        return {"total": focal + shape.contrast * con + RECONSTRUCTION * ae, "focal": focal, "contrast": con, "reconstruction": ae}


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def focal_loss(logits: np.ndarray, y: np.ndarray, shape: Shape) -> tuple[float, np.ndarray]:
    n, k = logits.shape
    w = np.array(shape.weights or [1.0] * k)
    w = w / w.mean()
    logp, line = log_softmax(logits), np.arange(n)
    p = np.exp(logp)
    pt = p[line, y]
    own = w[y]
    ce = (1 - SMOOTH) * own * -logp[line, y] + SMOOTH / k * -(logp * w).sum(axis=1)
    one = np.zeros_like(p)
    one[line, y] = 1
    d_ce = (1 - SMOOTH) * own[:, None] * (p - one) + SMOOTH / k * (p * w.sum() - w)
    d_pt = pt[:, None] * (one - p)
    times = np.ones(n)
    if shape.pair:
        a, b = shape.pair
        guess = logits.argmax(axis=1)
        times[((y == a) & (guess == b)) | ((y == b) & (guess == a))] = PAIR_PENALTY
    far = 1 - pt
    slope = times[:, None] * (far[:, None] ** shape.gamma * d_ce - shape.gamma * far[:, None] ** (shape.gamma - 1) * d_pt * ce[:, None]) / n
    return float((times * far**shape.gamma * ce).mean()), slope


def contrastive_loss(e: np.ndarray, y: np.ndarray, pair: tuple[int, int] | None, slopes: bool = True) -> tuple[float, np.ndarray]:
    """Supervised contrastive loss of rows of length 1, with the hardest negatives between one pair of classes.

    Of all pairs of rows only the similarities are made; what concerns rows of one class comes from sums over classes.
    """
    n = len(e)
    cos = e @ e.T
    _, own = np.unique(y, return_inverse=True)
    each = np.eye(own.max() + 1)[own] if n else np.zeros((0, 0))
    mates = lambda v: (each.T @ v)[own] - v  # noqa: E731  (of each row, the sum over the other rows of its class)
    count = mates(np.ones((n, 1)))[:, 0] if n else np.zeros(0)
    valid = count > 0
    value, slope = 0.0, np.zeros_like(e)
    if valid.any() and n > 1:
        # no similarity of rows of length 1 is over 1 / TEMPERATURE, nor so far below it that its share is lost
        near = cos - 1
        near /= TEMPERATURE
        np.exp(near, out=near)
        np.fill_diagonal(near, 0)
        total = near.sum(axis=1)
        logs = (e * mates(e)).sum(axis=1) / TEMPERATURE - count * (1 / TEMPERATURE + np.log(total))
        value = float(-(logs[valid] / count[valid]).mean())
        if slopes:
            part = valid / valid.sum() / TEMPERATURE
            a, c = (part / total)[:, None], (part / np.maximum(count, 1))[:, None]
            slope = a * (near @ e) + near @ (a * e) - c * mates(e) - mates(c * e)
    if pair:
        a, b = np.flatnonzero(y == pair[0]), np.flatnonzero(y == pair[1])
        cross = cos[np.ix_(a, b)].ravel() if pair[0] != pair[1] else np.zeros(0)
        if len(cross):
            # each pair of rows counts in both orders; only the nearest ones are put in order
            least = min(len(cross), -(-NEGATIVE_TOP // 2))
            at = np.flatnonzero(cross >= np.partition(cross, len(cross) - least)[len(cross) - least])
            i, j = a[at // len(b)], b[at % len(b)]
            i, j, near = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(cross[at], 2)
            first = np.lexsort((i * n + j, -near))[:NEGATIVE_TOP]
            i, j, u = i[first], j[first], (near[first] - NEGATIVE_MARGIN) / TEMPERATURE
            value += NEGATIVE_WEIGHT * float(np.logaddexp(0, u).mean())
            if slopes:
                g = (NEGATIVE_WEIGHT / (1 + np.exp(-u)) / TEMPERATURE / len(first))[:, None]
                np.add.at(slope, i, g * e[j])
                np.add.at(slope, j, g * e[i])
    return value, slope


def rows_of(df: DataFrame, key: str, features: list[str], label: str, classes: list[str]) -> DataFrame:
    """key, x, y of the rows that train."""
    number = F.lit(None).cast("int")
    for i, name in enumerate(classes):
        number = F.when(F.col(label) == name, i).otherwise(number)
    known = df.where(F.col(label).isNotNull())
    x = F.array(*(F.col(f).cast("double") for f in features))
    number = F.when(number.isNull(), F.raise_error(F.concat(F.lit("not a class: "), F.col(label))).cast("int")).otherwise(number)
    return known.select(F.col(key).cast("string").alias("key"), x.alias("x"), number.alias("y")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def round_sums(rows: DataFrame, shape: Shape, flat: np.ndarray, slopes: bool = True) -> tuple[int, dict[str, float], np.ndarray]:
    """Rows, mean losses and mean gradient over all rows, each chunk weighted by its rows."""
    shared = rows.sparkSession.sparkContext.broadcast(flat)
    names = ["total", "focal", "contrast", "reconstruction"]
    size = len(flat) if slopes else 0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, grad = 0, np.zeros(4), np.zeros(size)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            y = batch.column(1).to_numpy()
            for at in range(0, len(x), shape.chunk):
                work = Pass(shape, shared.value)
                losses = work.loss(x[at : at + shape.chunk], y[at : at + shape.chunk], slopes)
                m = len(y[at : at + shape.chunk])
                n += m
                sums += m * np.array([losses[k] for k in names])
                if slopes:
                    grad += m * work.grad
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([grad.tobytes()], pa.binary())], ["n", "sums", "grad"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, grad = 0, np.zeros(4), np.zeros(size)
        for batch in batches:
            for r in batch.to_pylist():
                n, sums, grad = n + r["n"], sums + np.array(r["sums"]), grad + np.frombuffer(r["grad"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([grad.tobytes()], pa.binary())], ["n", "sums", "grad"])

    schema = "n long, sums array<double>, grad binary"
    parts = rows.select("x", "y").mapInArrow(partial, schema)
    few = max(1, int(np.sqrt(float(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    found = parts.repartition(few).mapInArrow(added, schema).collect()
    n = sum(r.n for r in found)
    if not n:
        raise ValueError("there are no rows to train on")
    sums = np.sum([r.sums for r in found], axis=0) / n
    grad = np.sum([np.frombuffer(bytes(r.grad)) for r in found], axis=0) / n if slopes else np.zeros(0)
    return n, dict(zip(names, sums.tolist(), strict=True)), grad


def train(rows: DataFrame, held: DataFrame, shape: Shape, rounds: int = 50, rate: float = 3e-3, patience: int = 8, share: float = 1.0, decay: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, list[dict[str, float]]]:
    """The weights of the round with the least loss on `held` rows, and the losses of all rounds.

    Steps are Adam's on gradients cut to length 1; training ends after `patience` rounds without a better loss.
    """
    flat, best, least, waited = start(shape, seed), None, np.inf, 0
    first, second, history = np.zeros_like(flat), np.zeros_like(flat), []
    for turn in range(1, rounds + 1):
        some = rows if share >= 1 else rows.where(F.pmod(F.xxhash64(F.lit(turn), "key"), F.lit(1 << 30)) < int(share * (1 << 30)))
        n, losses, grad = round_sums(some, shape, flat)
        grad = grad / max(1.0, float(np.sqrt(grad @ grad)))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        step = (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
        flat = flat - rate * (step + decay * flat)
        value = round_sums(held, shape, flat, slopes=False)[1]["total"]
        history.append({"round": turn, "rows": n, **losses, "held": value})
        if value < least:
            best, least, waited = flat.copy(), value, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best if best is not None else flat, history


def outputs(shape: Shape, flat: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Per row: class, its probability, reconstruction error, and the slope score.

    The slope score is the length of the slope of the cross entropy with the guessed class at the last hidden layer.
    """
    work = Pass(shape, flat)
    h, _ = work.backbone(x)
    logits, _ = work.dense("head", h)
    p = np.exp(log_softmax(logits))
    guess = p.argmax(axis=1)
    rest = p.copy()
    rest[np.arange(len(x)), guess] -= 1
    again, _ = work.chain([f"ae{i}" for i in range(6)], x)
    slope = np.sqrt(((rest @ work.w["head.w"].T) ** 2).sum(axis=1))
    return {"guess": guess, "max_prob": p.max(axis=1), "ae_score": ((again - x) ** 2).mean(axis=1), "slope": slope}


def scored(rows: DataFrame, shape: Shape, flat: np.ndarray, classes: list[str]) -> DataFrame:
    """key, classifier_class, max_prob, ae_score, slope of rows (key, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                out = outputs(shape, shared.value, part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
                columns = [part.column(0), pa.array([classes[i] for i in out["guess"]]), *(pa.array(out[k]) for k in ("max_prob", "ae_score", "slope"))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "classifier_class", "max_prob", "ae_score", "slope"])

    return rows.select("key", "x").mapInArrow(run, "key string, classifier_class string, max_prob double, ae_score double, slope double")
