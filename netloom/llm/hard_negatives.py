"""Hard-negative mining by two-dimensional block matrix multiplication.

Scores are integer inner products of anchors with all rows. Rows are dealt into blocks and every block's vectors cut
into chunks of dimensions, anchors alike; the chunks of each (anchor block, row block) are shuffled together, each
(anchor block, row block, chunk) is multiplied by itself, and the partial int64 tiles of a block pair are added where
they are made. Of each added tile only the best rows per anchor go on: first those of the anchor's label, which after
a merge over all tiles are its positives, then, in a second multiplication, for each positive's window of scores, the
best rows of other labels. No tile is written or shuffled, no task holds more than one, whatever the rows, the labels
or their shares, and nothing is broadcast.

Rows: those with a null label, a null vector or a null component take no part. Vectors of different lengths are mined
apart; vectors without components score 0 with each other. A null vec_id comes after all others of equal score and is
no anchor. Repeated rows are rows of their own: a copy of an anchor may be its positive, and each copy is an anchor.
An anchor without other rows of its label, or without rows in a window, gives no rows; an empty table gives none.
Other columns are ignored, whatever their names. Vectors so long that a hundred times a score would leave 64 bits
raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import discard, materialize, runs

#: Rows of a row block on average, anchors of an anchor block on average, dimensions of a chunk.
ROWS, ANCHORS, CHUNK = 1024, 128, 32
#: Rows go to every anchor block: with over CELLS cells those grow, up to WIDER times.
CELLS, WIDER = 64, 8
#: The grid is dealt into more tasks from so many bytes of chunks a task on, into so many tasks at most.
TASK_BYTES, MOST_TASKS = 256 << 20, 4000
NO_ID = (1 << 63) - 1
#: Squared length from which a hundred times a score may leave 64 bits.
LONGEST = 9e16


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector: components x as floor(scale * x); rows with nulls or components that are not finite go."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", "label", F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("vector"))


def relabelled(rows: DataFrame, every: int, labels: int) -> DataFrame:
    """Rows whose vec_id is divisible by `every` get the next of so many labels."""
    label = F.col("label").cast("long")
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label))


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 or 8 bytes each that holds them all, behind that number of bytes."""
    top = max(-int(x.min()), int(x.max())) if x.size else 0
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def _unpacked(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(rows, -1).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def _long(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _chunks(dims: int, chunk: int) -> list[tuple[int, int, int]]:
    """Number, begin and end of each chunk of dimensions; vectors without any have an empty one."""
    return [(k, a, min(a + chunk, dims)) for k, a in enumerate(range(0, max(dims, 1), chunk))]


_BLOCK = "dims int, b int, d int, n int, ids binary, labels binary, part binary"
_ANCHOR = "dims int, a int, d int, m int, a_ids binary, a_labels binary, own binary, a_part binary"


def row_blocks(base: DataFrame, parts: int, chunk: int) -> DataFrame:
    """A row for each block and chunk; ids and labels with the first chunk only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dims, b), rows in runs(batches, 2):
            ids, labels = (rows.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            vectors = rows.column(4).combine_chunks().flatten().to_numpy().reshape(len(ids), dims)
            for d, at, to in _chunks(dims, chunk):
                meta = (ids.tobytes(), labels.tobytes()) if d == 0 else (None, None)
                row = (dims, b, d, len(ids), *meta, _packed(vectors[:, at:to]))
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES_B, row, strict=True))], _SCHEMA_B)

    at = ["dims", "b"]
    return base.select(*at, "id", "label", "vector").repartition(parts, *at).sortWithinPartitions(*at, "place").mapInArrow(run, _BLOCK)


def anchor_blocks(base: DataFrame, parts: int, chunk: int) -> DataFrame:
    """A row for each anchor block and chunk; own holds, for each anchor, its row block and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dims, a), rows in runs(batches, 2):
            ids, labels, block, place = (rows.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4, 5))
            vectors = rows.column(6).combine_chunks().flatten().to_numpy().reshape(len(ids), dims)
            own = np.stack([block, place], axis=1).tobytes()
            for d, at, to in _chunks(dims, chunk):
                row = (dims, a, d, len(ids), ids.tobytes(), labels.tobytes(), own, _packed(vectors[:, at:to]))
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES_A, row, strict=True))], _SCHEMA_A)

    rows = base.where("anchor").select("dims", "a", "id", "label", "b", "place", "vector")
    return rows.repartition(parts, "dims", "a").sortWithinPartitions("dims", "a", "b", "place").mapInArrow(run, _ANCHOR)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


_SCHEMA_B, _SCHEMA_A = _schema(_BLOCK), _schema(_ANCHOR)
_NAMES_B, _NAMES_A = _SCHEMA_B.names, _SCHEMA_A.names


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left times the transpose of right, exact: in doubles where no sum leaves 53 bits, else in integers."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    bound = int(np.abs(left).max()) * int(np.abs(right).max()) * left.shape[1]
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def cells(blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_anchors: int, parts: int) -> DataFrame:
    """The chunks of both sides of each cell of the grid (dims, a, b), one behind the other, the anchors' before the rows'.

    A block goes to all cells of its row or column of the grid. Nothing is joined: chunks of small whole numbers are
    packed to a fraction of their size, by which a join would send one side to the driver and from there to all executors.
    """
    along = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    names = ["dims", "a", "b", "d", "side", "n", "ids", "labels", "own", "part", "positives"]
    left = anchors.withColumns({"b": along(n_blocks), "side": F.lit(0)}).withColumnsRenamed({"m": "n", "a_ids": "ids", "a_labels": "labels", "a_part": "part"})
    if "positives" not in left.columns:
        left = left.withColumn("positives", none(_POSITIVES))
    right = blocks.withColumns({"a": along(n_anchors), "side": F.lit(1), "own": none("binary"), "positives": none(_POSITIVES)})
    at = ["dims", "a", "b"]
    return left.select(names).union(right.select(names)).repartition(parts, *at).sortWithinPartitions(*at, "d", "side")


_POSITIVES = "array<struct<i:int,p:int,score:bigint,id:bigint>>"


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of each cell with both sides, its tile (the sum of its chunks' products) and what is known of its anchors and rows.

    A task holds one tile and the two chunks that are multiplied.
    """
    now, left, cell = None, (None, None), {}
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            at = r["dims"], r["a"], r["b"]
            if at != now:
                if "tile" in cell:
                    yield cell
                now, left, cell = at, (None, None), {"dims": r["dims"], "a": r["a"], "b": r["b"]}
            part = _unpacked(r["part"], r["n"])
            if r["side"] == 0:
                left = r["d"], part
                if r["d"] == 0:
                    cell |= {"m": r["n"], "a_ids": r["ids"], "a_labels": r["labels"], "own": r["own"], "positives": r["positives"] or []}
            elif left[0] == r["d"]:
                made = product(left[1], part)
                if r["d"] == 0:
                    cell |= {"n": r["n"], "ids": r["ids"], "labels": r["labels"], "tile": made}
                else:
                    cell["tile"] += made
    if "tile" in cell:
        yield cell


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by falling score, then rising id."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


#: Candidates are handed on from so many rows.
_HELD = 20_000


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema.names)


def positive_candidates(grid: DataFrame, k: int) -> DataFrame:
    """dims, a, i, score, id: of each cell's tile, the first k other rows of each anchor's label."""
    out_ddl = "dims int, a int, i int, score long, id long"
    schema = _schema(out_ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for r in tiles(batches):
            tile, ids, labels, of = r["tile"], _long(r["ids"]), _long(r["labels"]), _long(r["a_labels"])
            own = _matrix(r["own"], r["m"])
            for i in range(r["m"]):
                same = labels == of[i]
                if own[i, 0] == r["b"]:
                    same[own[i, 1]] = False
                same = np.flatnonzero(same)
                for j in same[best(tile[i, same], ids[same], k)].tolist():
                    out.append((r["dims"], r["a"], i, int(tile[i, j]), int(ids[j])))
            if len(out) > _HELD:
                yield _rows(out, schema)
                out = []
        if out:
            yield _rows(out, schema)

    return grid.mapInArrow(run, out_ddl)


def negative_candidates(grid: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Of each cell's tile with its anchors' positives, the first k rows of other labels in each positive's window."""
    out_ddl = "dims int, a int, i int, p int, anchor_id long, positive_id long, positive_score long, negative_score long, id long"
    schema = _schema(out_ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for r in tiles(batches):
            tile, ids, labels = r["tile"], _long(r["ids"]), _long(r["labels"])
            of, names = _long(r["a_labels"]), _long(r["a_ids"])
            for p in r["positives"]:
                i, score = p["i"], p["score"]
                at = np.flatnonzero((labels != of[i]) & (100 * tile[i] >= low * score) & (100 * tile[i] <= high * score))
                for j in at[best(tile[i, at], ids[at], k)].tolist():
                    out.append((r["dims"], r["a"], i, p["p"], int(names[i]), p["id"], score, int(tile[i, j]), int(ids[j])))
            if len(out) > _HELD:
                yield _rows(out, schema)
                out = []
        if out:
            yield _rows(out, schema)

    return grid.mapInArrow(run, out_ddl)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = ROWS, anchor_block: int = ANCHORS, chunk: int = CHUNK) -> DataFrame:
    """Rows vec_id, label, vector (whole numbers); anchors says which of them are anchors.

    An anchor's positives are its first other rows of the same label. For each of them: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score of the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-rows.count() // block))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = rows.where(F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda v: v.isNotNull()), F.lit(False)))
    checked = F.when(squares < LONGEST, F.col("vector").cast("array<long>")).otherwise(F.raise_error(F.lit("vectors are too long for scores of 64 bits")).cast("array<long>"))
    number = F.monotonically_increasing_id()  # written at once, so that it holds from here on
    base = usable.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), checked.alias("vector"), (F.coalesce(anchors, F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor"), number.alias("number"))
    base = materialize(base.withColumn("dims", F.size("vector")).withColumn("b", F.pmod(F.xxhash64("number"), F.lit(n_blocks)).cast("int")))
    seen = base.agg(F.count_if("anchor"), F.max("dims")).first()
    most = WIDER * anchor_block
    while anchor_block < most and seen[0] > anchor_block and n_blocks * -(-seen[0] // anchor_block) > CELLS:
        anchor_block *= 2
    n_anchors = max(1, -(-seen[0] // anchor_block))
    placed = base.withColumn("place", F.row_number().over(Window.partitionBy("dims", "b").orderBy("number")) - 1)
    placed = placed.withColumn("a", F.pmod(F.xxhash64(F.lit(1), "number"), F.lit(n_anchors)).cast("int"))
    blocks, own = row_blocks(placed, parts, chunk), anchor_blocks(placed, parts, chunk)
    bytes_ = 8 * (seen[1] or 1) * n_anchors * n_blocks * (block + anchor_block)
    spread = max(parts, min(MOST_TASKS, bytes_ // TASK_BYTES))
    order = Window.partitionBy("dims", "a", "i").orderBy(F.desc("score"), "id")
    first = positive_candidates(cells(blocks, own, n_blocks, n_anchors, spread), positives).withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives)
    # at most anchor_block * positives or so in a list
    first = materialize(first.groupBy("dims", "a").agg(F.collect_list(F.struct("i", "p", "score", "id")).alias("positives")))
    # tiles are multiplied again rather than written: they hold anchors x rows numbers
    own = own.join(first.withColumn("d", F.lit(0)).hint("merge"), ["dims", "a", "d"], "left")
    found = negative_candidates(cells(blocks, own, n_blocks, n_anchors, spread), negatives, low, high)
    order = Window.partitionBy("dims", "a", "i", "p").orderBy(F.desc("negative_score"), "id")
    found = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives))
    discard(base)
    discard(first)
    named = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return found.select("anchor_id", named("positive_id").alias("positive_id"), "rank", named("id").alias("negative_id"), "positive_score", "negative_score")


#: The same result in DuckDB, every anchor against all rows.
SQL = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                       list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS number
                FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
     scores AS (SELECT a.number AS own, a.vec_id AS anchor_id, a.label = r.label AS same, r.number AS number, r.vec_id AS vec_id,
                       list_inner_product(a.v, r.v)::BIGINT AS score
                FROM usable a JOIN usable r ON len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
     positives AS (SELECT own, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS p
                   FROM scores WHERE same AND number <> own QUALIFY p <= 5)
SELECT p.anchor_id AS anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.own, p.p ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.own = p.own AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
