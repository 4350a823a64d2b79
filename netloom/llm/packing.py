"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A window of `length` tokens owes each source its target share; what a source
got too little is its deficit and is carried to the next windows, so that the source with the largest deficit
(the earliest due token) is served first. The state after any number of windows has a direct form (`served`),
so each partition takes up the deficits where the windows before it left them, without playing them again.
Documents are cut where a source's share of a window ends; all windows but the last are full.

With more than MAX_QUEUES sources a queue is a group of sources, chosen by a hash, and owed the sum of their shares.
Inside a group the sources take turns by whole documents (`grouped`): the document whose middle token is due first
goes first, so that each stretch of a group holds its sources in proportion, to within a document each.

Queue order is the order of the materialized token table: chunks as written, rows as they stand in a chunk.
Rows: a null text counts as empty and packs as the end id alone; a null source is a queue of its own; repeated
rows are packed each; other columns are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import library_tokens
from netloom.llm.common import discard, freed, materialize, slices, tidy

LENGTH = 2048
#: With more sources than this, a queue is a group of sources; inside it whole documents take turns by due time.
MAX_QUEUES = 256
#: The table of offsets goes to all executors up to so many rows, else it is joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Queue of a source: a mark before its name, so that the null source (no mark) is none of the named ones.
MARK = "="


def tokenized(docs: DataFrame, path: str, end_id: int, cached_words: int = library_tokens.CACHED_WORDS, block_bytes: int = library_tokens.BLOCK_BYTES) -> DataFrame:
    """doc_id, queue (one a source), chunk, before (tokens of the queue earlier in the chunk), n_tokens, ids; materialized."""
    queue = F.coalesce(F.concat(F.lit(MARK), "source"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens.loaded(path, cached_words)
        end = np.array([end_id], tokens.dtype).tobytes()
        chunk, seen = TaskContext.get().partitionId(), {}
        for batch in library_tokens.blocks(batches, most=block_bytes):
            ids = [b + end for b in tokens.encode_batch(batch.column(1))]
            counts = [len(b) // tokens.width for b in ids]
            yield _placed(batch.column(0), batch.column(2), batch.column(2), chunk, seen, counts, pa.array(ids, pa.binary()))
            del ids
            freed()

    return materialize(docs.select("doc_id", "text", queue.alias("queue")).mapInArrow(tidy(run), PLACED))


PLACED = "doc_id long, source string, queue string, chunk int, before long, n_tokens long, ids binary"


def _placed(doc_ids: pa.Array, sources: pa.Array, queues: pa.Array, chunk: int, seen: dict, counts: list[int], ids: pa.Array) -> pa.RecordBatch:
    """Rows of PLACED; seen holds the tokens of each queue so far in the chunk and is carried on."""
    before = []
    for q, n in zip(queues.to_pylist(), counts, strict=True):
        before.append(seen.get(q, 0))
        seen[q] = before[-1] + n
    columns = [doc_ids, sources, queues, pa.array([chunk] * len(counts), pa.int32()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), ids]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "queue", "chunk", "before", "n_tokens", "ids"])


def chunk_sums(table: DataFrame) -> DataFrame:
    """queue, chunk, n (tokens), chunk_start (tokens of the queue in earlier chunks); materialized."""
    sums = table.groupBy("queue", "chunk").agg(F.sum("n_tokens").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return materialize(sums.select("queue", "chunk", F.coalesce(earlier, F.lit(0)).alias("chunk_start"), "n"))


def queue_shares(sums: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """queue, total (tokens), share (weight, by default the total) of each queue of chunk_sums."""
    totals = sums.groupBy("queue").agg(F.sum("n").alias("total"))
    if not weights:
        return totals.withColumn("share", F.col("total").cast("double"))
    given = sums.sparkSession.createDataFrame([(MARK + s, float(w)) for s, w in weights.items()], "queue string, share double")
    return totals.join(F.broadcast(given) if len(weights) <= MAX_BROADCAST_ROWS else given, "queue", "left").na.fill(1.0, ["share"])


def with_offsets(table: DataFrame, offsets: DataFrame) -> DataFrame:
    """Joins a row for each queue and chunk; broadcast up to MAX_BROADCAST_ROWS rows."""
    return table.join(F.broadcast(offsets) if offsets.count() <= MAX_BROADCAST_ROWS else offsets, ["queue", "chunk"])


def grouped(table: DataFrame, sums: DataFrame, shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, shares) with MAX_QUEUES groups of sources as queues, each in the order of its documents' due times.

    Ranges of (group, due time) are the chunks, so that neither a hot source nor a large group is one task's.
    """
    group = F.pmod(F.xxhash64("queue"), F.lit(MAX_QUEUES)).cast("string")
    offsets = materialize(sums.join(shares, "queue").select("queue", "chunk", "chunk_start", "share"))
    due = (F.col("chunk_start") + F.col("before") + F.col("n_tokens") / 2) / F.col("share")
    rows = with_offsets(table, offsets).select("doc_id", "source", group.alias("queue"), due.alias("due"), "n_tokens", "ids")
    order = ["queue", "due", "doc_id", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            yield _placed(batch.column(0), batch.column(1), batch.column(2), chunk, seen, batch.column(4).to_pylist(), batch.column(5))

    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), PLACED))
    return placed, shares.groupBy(group.alias("queue")).agg(F.sum("total").alias("total"), F.sum("share").alias("share"))


def served(tokens: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How many tokens each queue has given once `tokens` tokens are packed: a row for each entry of tokens.

    Token y of queue s is due at (y + 0.5) / weight; tokens are packed in order of (due time, queue). A queue that
    ran out leaves its share to the others. Rows sum to `tokens` exactly and never decrease from row to row.
    """
    order = np.argsort(totals / weights, kind="stable")
    ends = (totals / weights)[order]
    rest = weights.sum() - np.concatenate([[0.0], np.cumsum(weights[order])[:-1]])
    filled = np.concatenate([[0.0], np.cumsum(np.diff(np.concatenate([[0.0], ends])) * rest)])
    time = np.interp(tokens, filled, np.concatenate([[0.0], ends]))
    n = np.clip(np.floor(time[:, None] * weights[None, :] + 0.5).astype(np.int64), 0, totals[None, :])
    rows = np.arange(len(tokens))
    while True:
        following = np.where(n < totals, (n + 0.5) / weights, np.inf)
        latest = np.where(n > 0, (n - 0.5) / weights, -np.inf)
        add = following.argmin(axis=1)
        drop = latest.shape[1] - 1 - latest[:, ::-1].argmax(axis=1)
        late, early = latest[rows, drop], following[rows, add]
        gap = tokens - n.sum(axis=1)
        swap = (gap == 0) & ((late > early) | ((late == early) & (drop > add)))
        more, less = (gap > 0) | swap, (gap < 0) | swap
        if not (more.any() or less.any()):
            return n
        n[rows[more], add[more]] += 1
        n[rows[less], drop[less]] -= 1


def pack(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = 1,
    length: int = LENGTH,
    weights: dict[str, float] | None = None,
    cached_words: int = library_tokens.CACHED_WORDS,
    block_bytes: int = library_tokens.BLOCK_BYTES,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue (the source) of each piece.

    weights: target token shares by source (by default in proportion to the sources' tokens, so that all end together).
    cached_words, block_bytes: words that a Python worker keeps and texts that it takes together; they bound its memory.
    """
    table = tokenized(docs, path or default_path(), end_id, cached_words, block_bytes)
    width = library_tokens.loaded(path or default_path()).width
    sums = chunk_sums(table)
    by_queue = queue_shares(sums, weights)
    if by_queue.count() > MAX_QUEUES:
        single, single_sums = table, sums
        table, by_queue = grouped(table, sums, by_queue)
        found = by_queue.collect()
        discard(single)
        discard(single_sums)
        sums = chunk_sums(table)
    else:
        found = by_queue.collect()
    found.sort(key=lambda r: r.queue)
    number = {r.queue: i for i, r in enumerate(found)}
    totals = np.array([r.total for r in found], np.int64)
    shares = np.array([r.share for r in found], np.float64)
    all_tokens = int(totals.sum()) if len(totals) else 0

    def windows_of(first: np.ndarray, totals_s: int, weight: float) -> np.ndarray:
        time = (first + 0.5) / weight
        filled = np.minimum(time[:, None] * shares[None, :], totals[None, :]).sum(axis=1)
        return np.floor(filled / length).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<u2" if width == 2 else "<u4")
        spread = len(totals) // length + 2
        for batch in slices(batches, 2000):
            doc_ids, ids = batch.column(0).to_pylist(), batch.column(5)
            sources = [q[len(MARK) :] if q else None for q in batch.column(7).to_pylist()]
            queue = np.array([number[q] for q in batch.column(1).to_pylist()], np.int64)
            counts = batch.column(4).to_numpy()
            begin = batch.column(6).to_numpy() + batch.column(3).to_numpy()
            low, high = (np.empty(len(queue), np.int64) for _ in range(2))
            for s in np.unique(queue):
                mine = queue == s
                low[mine] = windows_of(begin[mine], totals[s], shares[s])
                high[mine] = windows_of(begin[mine] + counts[mine] - 1, totals[s], shares[s])
            low, high = np.maximum(low - spread, 0), high + spread + 1
            n_windows = high - low
            flat = np.repeat(low, n_windows) + np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
            marks, at = np.unique(np.concatenate([flat, flat + 1]), return_inverse=True)
            given = served(np.minimum(marks * length, all_tokens), totals, shares)
            before, after = at[: len(flat)], at[len(flat) :]
            doc = np.repeat(np.arange(len(queue)), n_windows)
            q = queue[doc]
            opens, closes = given[before, q], given[after, q]
            start = np.maximum(opens, begin[doc])
            stop = np.minimum(closes, begin[doc] + counts[doc])
            here = stop > start
            doc, q, flat, start, stop, opens, before, after = (v[here] for v in (doc, q, flat, start, stop, opens, before, after))
            share = given[after] - given[before]
            earlier = np.where(np.arange(len(totals))[None, :] < q[:, None], share, 0).sum(axis=1)
            offset = earlier + start - opens
            local, sizes = start - begin[doc], stop - start
            crcs, last, wide = [], -1, b""
            for d, a, n in zip(doc.tolist(), local.tolist(), sizes.tolist(), strict=True):
                if d != last:
                    last, wide = d, np.frombuffer(ids[d].as_py(), dtype).astype("<u4").tobytes()
                crcs.append(zlib.crc32(wide[4 * a : 4 * (a + n)]))
            columns = [
                pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()),
                *(pa.array(v, pa.int64()) for v in (local, sizes, crcs, counts[doc], flat, offset)),
                pa.array([sources[d] for d in doc.tolist()], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    joined = with_offsets(table, sums.select("queue", "chunk", "chunk_start"))
    return joined.select("doc_id", "queue", "chunk", "before", "n_tokens", "ids", "chunk_start", "source").mapInArrow(tidy(run), schema)
