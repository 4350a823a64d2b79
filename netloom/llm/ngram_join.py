"""N-gram Jaccard join by parity sketches.

Shingles (five words) are hashed to 64 bits. Each shingle flips one bit of a document's parity sketch, so the
Hamming distance of two sketches never exceeds the symmetric difference of the sets; a pair at the threshold
differs in at most (|A| + |B|) (1 - t) / (1 + t) shingles. A document's sketch is also cut into bands: every shingle
falls into one band and XORs its hash into the band's word, and a band that holds no differing shingle is equal
on both sides. The number of bands (and of independently seeded sketches, for short documents) belongs to a band of
set sizes and is chosen so that the chance that a pair at the threshold shares no band of two or more shingles
is below exp(-MATCHES); candidates are the pairs with a common band, in one size band, within the Hamming bound.
They are verified on the whole sets.

Equal sets are one class, found first by a hash of the set. In a bucket of candidates each member is paired with
one pivot; buckets that afterwards still hold several components are joined in full, members of different
components only, so that groups of near copies cost one pair a member and no link between candidates is lost: what may be
missed is a pair without a common band, by the chance above. Sets of at most 15 shingles have exact keys instead.

Rows: a null, empty or blank text has no shingles and links with nothing; fewer words than five make one shingle;
repeated rows are copies; a null doc_id keeps its row with a null component and takes no part; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import library_tokens
from netloom.llm.cells import in_cells
from netloom.llm.common import TwoGenerations, discard, materialize, slices, spread_join, tidy
from netloom.llm.components import components

N, PERCENT = 5, 75
#: Expected common bands of a pair at the threshold: the chance to miss one is about exp(-MATCHES).
MATCHES = 16
#: Bits of the parity sketch that filters candidates.
SKETCH_BITS = 1024
BLOCK = 512
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(TwoGenerations):
    """64-bit hashes of words, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.old[word] if word in self.old else xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: runs of bytes other than space and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(found: list[bytes], hashes: WordHashes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words make one shingle."""
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def _common_bands(size: float, bands: int, t: float) -> float:
    """Expected bands of a sketch with two or more common shingles and no differing one, for equal sizes at the threshold."""
    common, differ = size * 2 * t / (1 + t) / bands, size * 2 * (1 - t) / (1 + t) / bands
    return bands * (1 - math.exp(-common) * (1 + common)) * math.exp(-differ)


_PLANS: dict[tuple[int, float], tuple[int, int]] = {}


def plan(level: int, t: float = PERCENT / 100) -> tuple[int, int]:
    """Bands and sketches of the size band [2**level, 2**(level+1)), the least of both that meets MATCHES."""
    if (level, t) not in _PLANS:
        low, high = max(2.0, t * 2**level), 2.0 ** (level + 1)
        best = None
        for share in (0.6, 0.8, 1, 1.25, 1.6, 2, 2.5, 3.2, 4, 5, 6.4, 8, 10, 12, 16):
            bands = max(1, round(low / share))
            worst = min(_common_bands(s, bands, t) for s in (low, (low + high) / 2, high))
            sketches = math.ceil(MATCHES / worst) if worst > 1e-9 else 10**9
            if sketches * bands <= 10**7 and (best is None or bands * sketches < best[0] * best[1]):
                best = (bands, sketches)
        _PLANS[level, t] = best
    return _PLANS[level, t]


def size_bands(size: int, t: float) -> list[int]:
    """Size bands a set takes part in: its own, and the next if it can be a partner there."""
    level = size.bit_length() - 1
    return [level, level + 1] if size >= t * 2 ** (level + 1) else [level]


def band_keys(hashes: np.ndarray, t: float = PERCENT / 100) -> np.ndarray:
    """64-bit keys of the bands with two or more shingles. Sets of at most SMALL shingles have exact keys instead."""
    out = []
    for level in size_bands(len(hashes), t) if len(hashes) else ():
        if 2 ** (level + 1) <= SMALL:
            out.append(small_keys(hashes, level, t))
            continue
        bands, sketches = plan(level, t)
        for s in range(sketches):
            h = mixed(hashes ^ np.uint64(0x1000003 * (s + 1)))
            band = (h % np.uint64(bands)).astype(np.int64)
            order = np.argsort(band, kind="stable")
            band, value = band[order], mixed(h[order])
            first = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            counts = np.diff(np.concatenate([first, [len(band)]]))
            xor = np.bitwise_xor.reduceat(value, first)
            good = counts >= 2
            place = (band[first[good]] + (s * bands)).astype(np.uint64) + np.uint64(level << 40)
            out.append(mixed(xor[good] + mixed(place)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


#: Up to so many shingles, keys are those shingles that a pair at the threshold cannot all differ in.
SMALL = 16


def small_keys(hashes: np.ndarray, level: int, t: float) -> np.ndarray:
    """The len - ceil(t len) + 1 least shingles: two sets at the threshold have one of them in common."""
    n = len(hashes)
    keys = np.sort(mixed(hashes ^ np.uint64(77)))[: n - math.ceil(t * n - 1e-9) + 1]
    return mixed(keys + np.uint64(level << 40))


def parity_sketch(hashes: np.ndarray) -> bytes:
    """SKETCH_BITS bits; a shingle flips one."""
    bits = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


_HASHES = WordHashes(400_000)


def sets(docs: DataFrame, n: int = N, with_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes: equal for equal sets), and with_keys: sketch, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_tokens.dropped()
        for batch in slices(batches):
            _HASHES.turn()
            sizes, ids, sketches, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(words(text), _HASHES, n)
                sizes.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if with_keys:
                    sketches.append(parity_sketch(s))
                    keys.append(band_keys(s).view(np.int64))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            names = ["doc_id", "n_shingles", "set_id"]
            if with_keys:
                columns += [pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                names += ["sketch", "keys"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_shingles long, set_id binary" + ", sketch binary, keys array<long>" * with_keys
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def hash_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_tokens.dropped()
        for batch in slices(batches):
            _HASHES.turn()
            s = [shingles(words(t), _HASHES, n).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, shingles binary")


def _hamming_passes(percent: int):
    """Filter on columns sketch_a, sketch_b, n_a, n_b: the distance is within the bound of the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
            n = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            far = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(far * (100 + percent) <= n * (100 - percent)))

    return run


def _across(rows: list[tuple], same: bool, percent: int) -> list[tuple]:
    """Pairs of a cell in different components, of sizes and Hamming distance within the bounds."""
    side, ids, part, size = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
    left = np.arange(len(rows)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    right = right[np.argsort(size[right], kind="stable")]
    sizes, out = size[right], []
    for i in left.tolist():
        low, high = np.searchsorted(sizes, -(-percent * size[i] // 100)), np.searchsorted(sizes, 100 * size[i] // percent, side="right")
        there = right[low:high]
        there = there[part[there] != part[i]]
        if same:
            there = there[there > i]
        if len(there):
            far = np.bitwise_count(bits[there] ^ bits[i]).sum(axis=1, dtype=np.int64)
            there = there[far * (100 + percent) <= (size[there] + size[i]) * (100 - percent)]
            out += [(min(int(ids[i]), k), max(int(ids[i]), k)) for k in ids[there].tolist()]
    return out


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) whose whole sets pass the threshold."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    whole = hash_sets(texts.join(wanted, "doc_id", "left_semi"), n)
    whole = materialize(whole)
    joined = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def links(docs: DataFrame, percent: int = PERCENT, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(membership, links): doc_id, n_shingles, rep (least doc_id with an equal set) of every row, and pairs (a, b) of reps.

    The pairs connect whatever the threshold connects; within a connected group not every close pair is listed.
    """
    docs = docs.select("doc_id", "text")
    every = materialize(sets(docs, n, with_keys=True))
    usable = every.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    # sets that several documents have; the others stand for themselves
    several = materialize(usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("set_id", "rep"))
    own = F.when(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")
    members = materialize(spread_join(every.select("doc_id", "n_shingles", "set_id"), several, ["set_id"], "doc_id", "left").select("doc_id", "n_shingles", own))
    # one document of each set; the keys stay where they are while the sets of several documents are few
    firsts = spread_join(usable, several, ["set_id"], "doc_id", "left").where(F.coalesce("rep", "doc_id") == F.col("doc_id"))
    keyed = firsts.select("doc_id", F.explode("keys").alias("key"))
    # the least and the greatest member of each bucket, by partial aggregates; buckets of one drop out
    ends = keyed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last")
    # written, so that the shuffle of all keys for the ends is gone before the one that finds the members
    ends = materialize(ends.select("key", "pivot"))
    shared = materialize(keyed.join(ends.hint("merge"), "key"))
    discard(ends)
    sketches = usable.select("doc_id", "sketch", "n_shingles")

    def close(pairs: DataFrame) -> DataFrame:
        left = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
        right = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
        sized = pairs.join(left, "a").join(right, "b").where(f"100 * na >= {percent} * nb AND 100 * nb >= {percent} * na")
        return sized.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(tidy(_hamming_passes(percent)), "a long, b long").distinct()

    stars = materialize(close(shared.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()))
    found = materialize(_verified(stars, docs, percent, n))
    discard(stars)
    parts = materialize(components(found))
    labelled = shared.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component_id", "doc_id"))
    # buckets that still hold several components: their members of different components, block by block
    open_ = labelled.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("c")).where("p < q AND c > 2").select("key")
    rest = labelled.join(open_, "key", "left_semi").select("key", "doc_id", "part").join(sketches, "doc_id")
    rest = rest.select("key", "doc_id", "part", "n_shingles", "sketch")

    def work(key: tuple, same: bool, rows: list[tuple]) -> list[tuple]:
        return _across(rows, same, percent)

    more = materialize(in_cells(rest, ["key"], "doc_id", BLOCK, work, ["a", "b"]).distinct())
    found = materialize(found.union(_verified(more, docs, percent, n)))
    for done in (every, several, shared, parts, more):
        discard(done)
    return members, found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every row."""
    members, found = links(docs, percent, n)
    parts = components(found).withColumnRenamed("id", "rep").withColumnRenamed("component_id", "part")
    joined = members.join(parts, "rep", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("part", "rep", "doc_id").alias("component_id"))
