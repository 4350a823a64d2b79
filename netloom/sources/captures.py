"""Captures as a data source: spark.read.format("capture").load(path), a large capture cut into ranges.

Records of a capture carry no marks, so a range has to find where one begins. It starts well before its first byte,
looks for a place from which a chain of plausible record headers leads on, and walks the chain up to its range. The
stretch before the range is longer than any packet may be, so a chain that began inside a packet has to meet the true
headers there, or to break, which makes the search go on behind it. The chain that a second search finds from another
place must lead to the same first record; if the two differ, or none is found, the file is walked from its beginning.
A range then reads the records that begin in it.

Rows: path, place (the record's byte, which tells packets apart and orders them), time and header fields, and with
option payload "true" the payload fields. Options: rangeBytes (64 MB), payload, strict. A packet that the format's
rules exclude gives no row; strict makes it raise. A file that is no capture raises. Empty folders give no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from netloom.sources import pcap

#: Bytes before a range that a search begins at, headers that a chain must have, and the greatest gap between their times.
BEFORE, CHAIN, GAP_SECONDS = 1 << 20, 6, 10 * 365 * 86_400
SCHEMA = pcap.SCHEMA.replace("capture_index long", "place long")


def opened(path: str):
    """A file of any file system that Arrow reads, with its size."""
    system, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(name)


@dataclass
class Stretch:
    """Bytes of a file from a place on, read as far as they are asked for."""

    file: object
    size: int
    order: str
    unit: int
    snap: int
    at: int = 0
    data: bytes = b""

    def bytes_at(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, 4 << 20))
        return self.data[at - self.at : at - self.at + n]

    def plausible(self, at: int) -> tuple[int, int] | None:
        """Where the next record would be, and the seconds, if a record may begin here."""
        if at + 16 > self.size:
            return None
        seconds, fraction, held, original = struct.unpack(self.order + "IIII", self.bytes_at(at, 16))
        if held > original or held > self.snap or fraction * self.unit >= 10**9 or original > (1 << 26) or at + 16 + held > self.size:
            return None
        return at + 16 + held, seconds

    def chained(self, at: int) -> bool:
        """Whether CHAIN plausible headers follow one another from here, or lead to the very end."""
        last = None
        for _ in range(CHAIN):
            if at == self.size:
                return True
            if (found := self.plausible(at)) is None or (last is not None and abs(found[1] - last) > GAP_SECONDS):
                return False
            at, last = found
        return True

    def walked(self, at: int, to: int) -> int | None:
        """The first record from `to` on, along the chain that begins at `at`; None if it breaks."""
        while at < to:
            if (found := self.plausible(at)) is None:
                return None
            at = found[0]
        return at

    def searched(self, begin: int, to: int) -> int | None:
        for at in range(begin, to + 1):
            if self.chained(at) and (first := self.walked(at, to)) is not None:
                return first
        return None

    def first(self, to: int) -> int:
        """The first record that begins at `to` or behind it."""
        before = max(BEFORE, 4 * min(self.snap, 1 << 22))
        if to - before > 24:
            one, other = self.searched(to - before, to), self.searched(to - before // 2, to)
            if one is not None and one == other:
                return one
        found = self.walked(24, to)
        if found is None:
            raise pcap.CaptureError("truncated record")
        return found


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangebytes", 64 << 20))
        self.payload, self.strict = options.get("payload", "false").lower() == "true", options.get("strict", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        system, name = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(name)
        files = [info] if info.is_file else [f for f in system.get_file_info(pyarrow.fs.FileSelector(name)) if f.is_file and not f.base_name.startswith(("_", "."))]
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        out = []
        for f in sorted(files, key=lambda f: f.path):
            out += [Range(prefix + f.path, at, min(at + self.step, f.size)) for at in range(0, max(f.size, 1), self.step)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        if part is None:
            return
        with opened(part.path) as file:
            size = file.size()
            stretch = Stretch(file, size, *pcap.header(file.read(24)))
            at = 24 if part.start <= 24 else stretch.first(part.start)
            while at < part.stop:
                if at + 16 > size:
                    raise pcap.CaptureError("truncated record header")
                held = struct.unpack(stretch.order + "IIII", stretch.bytes_at(at, 16))[2]
                if at + 16 + held > size:
                    raise pcap.CaptureError("truncated record")
                rows, _ = pcap.records(stretch.bytes_at(at, 16 + held), 0, 16 + held, stretch.order, stretch.unit, stretch.snap, self.strict)
                for row in rows:
                    yield (part.path, at, *row[1:]) if self.payload else (part.path, at, *row[1:10])
                at += 16 + held


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return f"{SCHEMA}, {pcap.PAYLOAD}" if self.options.get("payload", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def numbered(packets: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """packets with capture_index, their number in the capture among the packets that gave rows: counts of ranges before, then ranks in a range."""
    cut = packets.withColumn("_r", F.floor(F.col("place") / range_bytes))
    counts = cut.groupBy("path", "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("path", "_r", (F.sum("_n").over(Window.partitionBy("path").orderBy("_r")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("path", "_r").orderBy("place"))
    return cut.join(before, ["path", "_r"]).withColumn("capture_index", F.col("_before") + rank - 1).drop("_r", "_before")
