"""Token-id files with a shared zstandard dictionary.

Each document's ids are compressed as a frame of their own under one dictionary trained on serialized id
arrays, so that a short document can be read without its neighbours. A file holds the documents of one range
of doc_id in ascending order: header (magic, id width, SHA-256 of the dictionary), frames, index (doc_id,
frame offset, number of ids), footer (place of the index, number of documents, magic). The dictionary lies
beside the files under its hash.

Rows: a null text counts as empty and yields the end id alone; a null doc_id sorts first and reads back as
null; repeated rows stay, next to each other; other columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import library_tokens
from netloom.llm.common import fraction_of, shared_dir

MAGIC = b"NLTOKEN1"
HEADER = struct.Struct("<8sI32s")
FOOTER = struct.Struct("<QQ8s")
NO_ID = -(1 << 63)
#: The dictionary is trained on about so many documents, chosen by a hash of doc_id, and so many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 110 << 10
LEVEL = 3
#: Ids sampled for each range of doc_id, and the most ranges.
IDS_A_FILE, MAX_FILES = 100, 10_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from a bounded sample (SAMPLE_DOCS, SAMPLE_BYTES); empty if the sample is too small to train on."""
    sample, _ = fraction_of(docs.select("doc_id", "text"), "doc_id", SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens.loaded(path)
        for batch in library_tokens.blocks(batches):
            ids = [b[:SAMPLE_BYTES] for b in tokens.encode_batch(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    rows = [bytes(r.ids) for r in sample.mapInArrow(run, "ids binary").limit(2 * SAMPLE_DOCS).collect()]
    rows = sorted(r for r in rows if len(r) >= 16)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, rows)) // 8), rows).as_bytes() if len(rows) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class FileWriter:
    def __init__(self, folder: str, name: str, width: int, dictionary_hash: bytes):
        store, root = open_store(folder)
        self.path = f"{root}/{name}"
        self.out = store.open_output_stream(self.path)
        self.out.write(HEADER.pack(MAGIC, width, dictionary_hash))
        self.at, self.ids, self.offsets, self.counts = HEADER.size, [], [], []

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.offsets.append(self.at)
        self.counts.append(n)
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        for column, kind in ((self.ids, "<i8"), ([*self.offsets, self.at], "<u8"), (self.counts, "<u8")):
            self.out.write(np.array(column, kind).tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.ids), MAGIC))
        self.out.close()


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, folder: str, name: str):
        store, root = open_store(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        magic, self.width, digest = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        at, n, end = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{name} is no token file")
        index = self.file.read_at(size - FOOTER.size - at, at)
        self.ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(index, "<u8", n, 16 * n + 8)
        data = b""
        if any(digest):
            with store.open_input_stream(f"{root}/{digest.hex()}.dict") as f:
                data = f.read()
            if hashlib.sha256(data).digest() != digest:
                raise ValueError("the dictionary is not the one the file was written with")
        self.frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")

    def get(self, i: int) -> np.ndarray:
        start, end = int(self.offsets[i]), int(self.offsets[i + 1])
        raw = self.frames.decompress(self.file.read_at(end - start, start), max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, self.dtype)

    def document(self, doc_id: int) -> np.ndarray:
        i = int(np.searchsorted(self.ids, doc_id))
        if i == len(self.ids) or self.ids[i] != doc_id:
            raise KeyError(doc_id)
        return self.get(i)

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = 0, files: int | None = None) -> list[dict]:
    """Writes the documents' ids to files under the folder, which all executors must reach.

    Returns the files in order of doc_id: name, first id, documents, ids, and the ids of all files before (start).
    Ranges of doc_id are cut at quantiles of a bounded sample of ids, IDS_A_FILE a file and MAX_FILES files at most.
    A task that runs again writes under another name; only the names returned count.
    """
    path = path or default_path()
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    n = min(MAX_FILES, files or max(1, docs.rdd.getNumPartitions()))
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    if dictionary:
        with store.open_output_stream(f"{root}/{digest.hex()}.dict") as f:
            f.write(dictionary)
    sample, _ = fraction_of(docs.select("doc_id"), "doc_id", IDS_A_FILE * n)
    some = np.sort(np.array([r.doc_id for r in sample.where("doc_id IS NOT NULL").limit(2 * IDS_A_FILE * n).collect()], np.int64))
    bounds = np.unique(some[[len(some) * i // n for i in range(1, n)]]) if len(some) else some
    ends = b"" if end_id is None else end_id

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens.loaded(path)
        end = b"" if ends == b"" else np.array([ends], tokens.dtype).tobytes()
        frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in library_tokens.blocks(batches):
            raw = [b + end for b in tokens.encode_batch(batch.column(1))]
            ids = batch.column(0)
            bucket = np.searchsorted(bounds, ids.fill_null(NO_ID).to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(bucket, pa.int32()), pa.array([len(r) // tokens.width for r in raw], pa.int64()), pa.array([frames.compress(r) for r in raw], pa.binary())],
                ["doc_id", "bucket", "n", "frame"],
            )

    width = library_tokens.loaded(path).width

    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, now, rows = None, None, []

        def end_file() -> None:
            writer.close()
            rows.append((now, writer.path.rsplit("/", 1)[1], writer.ids[0], len(writer.ids), sum(writer.counts)))

        for batch in batches:
            for doc_id, bucket, count, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if writer:
                        end_file()
                    writer, now = FileWriter(folder, f"part-{bucket:07d}-{uuid.uuid4().hex[:12]}.bin", width, digest), bucket
                writer.add(doc_id, count, frame)
        if writer:
            end_file()
        names = ["bucket", "name", "first_id", "docs", "ids"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    parts = (
        docs.mapInArrow(compress, "doc_id long, bucket int, n long, frame binary")
        .repartitionById(len(bounds) + 1, "bucket")
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first())
        .mapInArrow(write_files, "bucket long, name string, first_id long, docs long, ids long")
    )
    out, start = [], 0
    for row in sorted(parts.collect(), key=lambda r: r.bucket):
        out.append(row.asDict() | {"start": start})
        start += row.ids
    return out


def read(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of int) from the files."""
    return _scan(spark, folder, files, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))


def digests(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    return _scan(spark, folder, files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()))


def _scan(spark: SparkSession, folder: str, files: list[dict], schema: str, last) -> DataFrame:
    listed = spark.createDataFrame([(f["name"], f["start"]) for f in files], "name string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = FileReader(folder, name)
                counts = reader.counts.astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                for at in range(0, len(counts), 500):
                    to = min(at + 500, len(counts))
                    ids = pa.array([None if i == NO_ID else i for i in reader.ids[at:to].tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(starts[at:to]), pa.array(counts[at:to]), last([reader.get(i) for i in range(at, to)])],
                        [c.split()[0] for c in schema.split(", ")],
                    )
                reader.close()

    return listed.repartition(max(1, len(files))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int | None = 0) -> DataFrame:
    """Writes the documents and returns digests() of what the files hold."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    return digests(spark, folder, write(docs, folder, path, end_id))
