"""CSV members of ZIP archives as a data source: a partition is a block of a member, so a large member is read in several tasks.

    spark.dataSource.register(ZippedCsv)
    spark.read.format("zipped_csv").option("member", "stops.txt").schema("stop_id string, stop_name string").load(folder)

The driver reads the archives' directories only. A task unpacks its member from the start, keeps nothing of what comes
before its block, and parses the records that begin in it; quoted line ends are followed. Only the columns of the schema
are built.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType


def decode(data: bytes, encodings: tuple[str, ...]) -> str:
    """Text by the first encoding that fits (SRC-3)."""
    for name in encodings:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {', '.join(encodings)} fits")


def archive_uris(path: str) -> list[str]:
    """The ZIP files of a folder, or the one file."""
    store, place = fs.FileSystem.from_uri(path)
    scheme = path[: len(path) - len(place)] if path.endswith(place) else ""
    if store.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    return sorted(scheme + f.path for f in store.get_file_info(fs.FileSelector(place)) if f.path.lower().endswith(".zip"))


def _open(uri: str) -> zipfile.ZipFile:
    store, place = fs.FileSystem.from_uri(uri)
    return zipfile.ZipFile(store.open_input_file(place))


def member_names(uri: str) -> list[str]:
    """The members by the archive's directory; nothing else of it is read."""
    with _open(uri) as z:
        return z.namelist()


def pick_member(names: list[str], pick: str, suffix: str = ".csv") -> str:
    """The first member with the suffix, the only one, or the one of that name (SRC-4, SRC-5)."""
    having = [n for n in names if n.lower().endswith(suffix)]
    if pick == "single" and len(having) != 1:
        raise ValueError(f"{len(having)} members end with {suffix}, not one")
    found = having if pick in ("first", "single") else [n for n in names if n.rpartition("/")[2] == pick]
    if not found:
        raise ValueError(f"no member {pick if pick not in ('first', 'single') else suffix}")
    return found[0]


def block_records(stream, start: int, end: int, chunk: int = 1 << 20) -> tuple[bytes, bytes]:
    """The first record of a CSV stream, and the bytes of all others that begin at start or later and before end."""
    offset, quotes, head, body = 0, 0, bytearray(), bytearray()
    headed, low = False, 0 if start == 0 else None
    while data := stream.read(chunk):
        a = np.frombuffer(data, np.uint8)
        inside = (quotes + np.cumsum(a == 34)) & 1
        starts = np.flatnonzero((a == 10) & (inside == 0)) + 1 + offset
        quotes = int(inside[-1])
        if not headed:
            headed = len(starts) > 0
            head += data[: starts[0] - offset] if headed else data
        if low is None and len(later := starts[starts >= start]):
            low = int(later[0])
        after = starts[starts >= end]
        if low is not None:
            body += data[max(0, low - offset) : int(after[0]) - offset if len(after) else len(data)]
        offset += len(data)
        if len(after):
            break
    return bytes(head), bytes(body[len(head) :] if start == 0 else body)


@dataclass
class Block(InputPartition):
    uri: str
    member: str
    start: int
    end: int


class ZippedCsv(DataSource):
    """Options: path (a ZIP file or a folder of them), member (single, first or a name), suffix (.csv), encodings (utf-8-sig,cp949,euc-kr: the first that fits a block), block (bytes of unpacked text a task, 64 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.pick, self.suffix, self.block = options.get("member", "single"), options.get("suffix", ".csv"), int(options.get("block", 64 << 20))
        self.encodings = tuple(options.get("encodings", "utf-8-sig,cp949,euc-kr").split(","))

    def members(self) -> list[tuple[str, zipfile.ZipInfo]]:
        found = []
        for uri in archive_uris(self.options["path"]):
            with _open(uri) as z:
                found.append((uri, z.getinfo(pick_member(z.namelist(), self.pick, self.suffix))))
        return found

    def schema(self) -> StructType:
        uri, info = self.members()[0]
        with _open(uri) as z, z.open(info) as f:
            head = block_records(f, 0, 0)[0]
        return StructType([StructField(h.strip(), StringType()) for h in next(csv.reader([decode(head, self.encodings)]), [])])

    def reader(self, schema: StructType) -> ZippedCsvReader:
        return ZippedCsvReader(self, schema.names)


class ZippedCsvReader(DataSourceReader):
    def __init__(self, source: ZippedCsv, columns: list[str]):
        self.source, self.columns = source, columns

    def partitions(self) -> list[Block]:
        size = self.source.block
        return [Block(uri, info.filename, at, min(at + size, info.file_size)) for uri, info in self.source.members() for at in range(0, max(1, info.file_size), size)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        with _open(block.uri) as z, z.open(block.member) as f:
            first, body = block_records(f, block.start, block.end)
        head = [h.strip() for h in next(csv.reader(io.StringIO(decode(first, self.source.encodings), newline="")), [])]
        if missing := [c for c in self.columns if c not in head]:
            raise ValueError(f"{block.uri} lacks columns: {', '.join(missing)}")
        at, held = [head.index(c) for c in self.columns], []
        rows = csv.reader(io.StringIO(decode(body, self.source.encodings), newline=""))
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) and r[i] != "" else None for r in held], pa.string()) for i in at], names=self.columns)
        for row in rows:
            held.append(row)
            if len(held) == 50_000:
                yield batch()
                held = []
        if held:
            yield batch()
