"""Suffix-array dedup: every byte covered by a WINDOW-byte string that starts anywhere else too is removed.

The suffixes are ordered only through WINDOW bytes, most significant digits first, in passes that keep the groups
of equal prefixes and drop groups of one:

1. The first digit is an anchor: of every window its minimizer, the DIGIT-byte string of least hash in it. Equal
   windows have equal anchors at equal places, so one row stands for all windows (a run) that share an anchor, and
   a window whose anchor occurs once in the corpus is unique.
2. The second digit is the whole span of a run. Runs whose span occurs twice are repeated in full.
3. Runs left open are ordered window by window through all WINDOW bytes; equal groups are the repeated windows.

Groups are counted by partial aggregates on 64-bit prefix hashes, in the last pass with the anchor's offset.
No group is gathered in a task, so a passage of any frequency costs a row an occurrence and pass.

Rows: a null text counts as empty; texts under WINDOW bytes lose nothing; repeated rows are separate documents and
lose all their windows; a null doc_id takes part and keeps its row; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import counted_join, discard, materialize, repeated, slices
from netloom.llm.ngram_join import mixed

WINDOW, DIGIT = 200, 100
_POSITION = 24
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _random_bytes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


class Rolling:
    """Hashes of substrings of one text by prefix sums modulo 2**64."""

    powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        if len(self.powers[0]) <= n:
            size = max(2 * len(self.powers[0]), n + 1)
            for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                Rolling.powers[i] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_random_bytes(seed)[data] * self.powers[0][:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.powers[1][start] + (stop - start).astype(np.uint64))

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:-width]) * self.powers[1][:n] + np.uint64(width))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring keys."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, window: int, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last window whose anchor it is."""
    hashes = Rolling(data).all(digit)
    low, width = np.uint64((1 << _POSITION) - 1), window - digit + 1
    at = np.empty(len(data) - window + 1, np.int64)
    # by hash, of equals the leftmost; a stretch of windows has all its places in one key's low bits
    step = (1 << _POSITION) - width + 1
    for begin in range(0, len(at), step):
        part = hashes[begin : begin + step + width - 1]
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        at[begin : begin + step] = (window_minima(keys, width) & low).astype(np.int64) + begin
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return hashes[at[first]], at[first], first, last


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def with_key(docs: DataFrame) -> DataFrame:
    """row, doc_id, text. Rows with equal id and text share their key: they lose the same bytes."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def prepared(docs: DataFrame, window: int, digit: int) -> DataFrame:
    """row, doc_id, n_bytes, full_sha256, anchors (array of hashes, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            sizes, shas, lists = [], [], []
            for text in batch.column(2).to_pylist():
                raw = _bytes(text)
                sizes.append(len(raw))
                shas.append(hashlib.sha256(raw).hexdigest())
                lists.append(anchors(np.frombuffer(raw, np.uint8), window, digit)[0].view(np.int64) if len(raw) >= window else None)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "full_sha256", "anchors"])

    return with_key(docs).mapInArrow(run, "row long, doc_id long, n_bytes long, full_sha256 string, anchors array<long>")


def removed(docs: DataFrame, window: int = WINDOW, digit: int = DIGIT, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, full_sha256 of every row, and of those that share a window's anchor with others n_removed, n_spans,
    kept_sha256 and, with texts, kept (bytes), spans (array of start, stop); null means that nothing goes."""
    table = materialize(prepared(docs, window, digit))
    # pass 1: anchors
    first = table.where("anchors IS NOT NULL").select("row", F.posexplode("anchors").alias("a", "h"))
    often = repeated(first, ["h"], "row").groupBy("row").agg(F.collect_set("a").alias("a"))
    live = materialize(with_key(docs).select("row", "text").join(often, "row"))

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out = ([], [], [], [], [])
            for row, text, chosen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(_bytes(text), np.uint8)
                chosen = np.sort(np.asarray(chosen, np.int64))
                h, at, begin, end = (v[chosen] for v in anchors(data, window, digit))
                out[0].append(np.full(len(h), row)), out[1].append(chosen)
                out[2].append(Rolling(data).of(begin, end + window).view(np.int64))
                out[3].append((at - begin) * 1024 + (at - end)), out[4].append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["row", "a", "h", "shape", "anchor"])

    # pass 2: whole spans of runs
    spans = materialize(live.mapInArrow(spans_of, "row long, a long, h long, shape long, anchor long"))
    groups = spans.groupBy("h", "shape").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("row", "a")).alias("one"), F.min("anchor").alias("anchor"))
    groups = materialize(groups.where("_n > 1"))
    marked = counted_join(spans, groups, ["h", "shape"], "row", "left", F.lit(True).alias("whole")).select("row", "a", "anchor", "whole")
    marked = materialize(marked)
    # one run of each closed group stands for it in the next pass, if an open run has its anchor
    open_anchors = marked.where("whole IS NULL").select("anchor").distinct()
    stand_ins = groups.join(open_anchors, "anchor", "left_semi").select("one.row", "one.a", F.lit(False).alias("whole"))
    lists = marked.select("row", "a", "whole").union(stand_ins).groupBy("row").agg(
        F.collect_set(F.when(F.col("whole"), F.col("a"))).alias("whole"), F.collect_set(F.when(F.coalesce("whole", F.lit(False)), None).otherwise(F.col("a"))).alias("open")
    )
    runs = materialize(live.join(lists, "row").select("row", "text", "whole", "open"))
    for done in (live, spans, marked, groups):
        discard(done)

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out = ([], [], [], [])
            for row, text, _, open_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_:
                    data = np.frombuffer(_bytes(text), np.uint8)
                    _, at, begin, end = anchors(data, window, digit)
                    chosen = np.sort(np.asarray(open_, np.int64))
                    at, begin, size = at[chosen], begin[chosen], end[chosen] - begin[chosen] + 1
                    p = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
                    out[0].append(np.full(len(p), row)), out[1].append(p)
                    out[2].append(Rolling(data).of(p, p + window).view(np.int64)), out[3].append(np.repeat(at, size) - p)
            if out[0]:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int16())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k, safe=False) for c, k in zip(out, kinds, strict=True)], ["row", "p", "h", "j"])

    # pass 3: single windows of the open runs and the stand-ins
    open_windows = runs.select("row", "text", "whole", "open").mapInArrow(windows_of, "row long, p int, h long, j short")
    open_windows = materialize(open_windows)
    more = repeated(open_windows, ["h", "j"], "row").groupBy("row").agg(F.collect_set("p").alias("p"))
    last = runs.select("row", "text", "whole").join(more, "row", "left")
    more_columns = ", kept binary, spans array<struct<start:long,stop:long>>" if texts else ""
    cut = materialize(last.mapInArrow(_cutter(window, digit, texts), "row long, n_removed long, n_spans long, kept_sha256 string" + more_columns))
    for done in (runs, open_windows):
        discard(done)
    return table.select("row", "doc_id", "n_bytes", "full_sha256").join(cut.dropDuplicates(["row"]), "row", "left")


def _cutter(window: int, digit: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out = ([], [], [], [], [], [])
            for row, text, whole, single in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = _bytes(text)
                data = np.frombuffer(raw, np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                if whole:
                    _, _, begin, end = anchors(data, window, digit)
                    whole = np.asarray(whole, np.int64)
                    np.add.at(edge, begin[whole], 1)
                    np.add.at(edge, end[whole] + window, -1)
                if single:
                    p = np.asarray(single, np.int64)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = data[~gone].tobytes()
                out[0].append(row), out[1].append(int(gone.sum())), out[2].append(len(flips) // 2)
                out[3].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out[4].append(kept), out[5].append([{"start": a, "stop": b} for a, b in flips.reshape(-1, 2).tolist()])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            n, names = 6 if texts else 4, ["row", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds[:n], strict=True)], names[:n])

    return run


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    zero = F.lit(0).cast("long")
    return removed(docs, texts=False).select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "full_sha256").alias("kept_sha256"))
