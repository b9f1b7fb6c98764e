"""Zip archives of one flat CSV each as a Spark data source: a partition an archive, its member read as a stream."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = "archive string, number long, line string, fault string"


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveSource(DataSource):
    """Lines of archives: archive, number (from 1), line, and a fault where there is one; options:

    path: a folder, or one archive, that pyarrow's file systems know; most_bytes: uncompressed, of a member; fields: how
    many a line has; whole: places of the fields that are whole numbers (from 0, by commas); header: what a header says.
    A first line whose first field is no whole number is a header and left out, if ``whole`` has that field; one that
    says something else than ``header``, where that is given, comes with its fault.

    An archive is refused (one row, without line) unless it has one member, in no folder, no link, a CSV within
    most_bytes; a line of other fields, and one without its whole numbers, comes with its fault. Memory is that of some
    lines, whatever the member's size."""

    @classmethod
    def name(cls) -> str:
        return "flat_archives"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("most_bytes", 1 << 30))
        self.fields = int(options.get("fields", 0))
        self.whole = [int(x) for x in options.get("whole", "").split(",") if x]
        self.header = options.get("header", "")
        self.batch = int(options.get("batch", 65_536))

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        system, at = _system(self.path)
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
        found = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.endswith(".zip"))
        head = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        return [Archive(head + p) for p in found]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        system, at = _system(partition.path)
        rows: list[tuple[int | None, str | None, str | None]] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            out = [pa.array([partition.path] * len(rows)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, ["archive", "number", "line", "fault"])

        try:
            with system.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                member, fault = self._member(z)
                if member is None:
                    rows.append((None, None, fault))
                else:
                    with z.open(member) as stream:
                        for number, line in enumerate(io.TextIOWrapper(Bounded(stream, self.most), "utf-8", newline=None), 1):
                            line = line.rstrip("\n")
                            fault = self._fault(line)
                            if number == 1 and fault and 0 in self.whole and not _is_whole(line.split(",")[0]):
                                if not self.header or line.rstrip("\r") == self.header:
                                    continue
                                fault = "unexpected header"
                            rows.append((number, line, fault))
                            if len(rows) >= self.batch:
                                yield batch()
        except (zipfile.BadZipFile, UnicodeDecodeError, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, pa.ArrowInvalid) as e:
            known = {TooLarge: "too large", pa.ArrowInvalid: "BadZipFile"}  # a seek before a short file's start
            rows.append((None, None, known.get(type(e), type(e).__name__)))
        if rows:
            yield batch()

    def _member(self, z: zipfile.ZipFile) -> tuple[zipfile.ZipInfo | None, str | None]:
        members = z.infolist()
        m = members[0] if len(members) == 1 else None
        if m is None or m.is_dir() or "/" in m.filename or "\\" in m.filename or m.filename.startswith(".."):
            return None, "not one flat file"
        if not m.filename.endswith(".csv") or (m.external_attr >> 16) & 0o170000 == 0o120000:
            return None, "not a csv file"
        if m.file_size > self.most:
            return None, "too large"
        return (m, None) if m.file_size else (None, "empty")

    def _fault(self, line: str) -> str | None:
        parts = line.split(",")
        if self.fields and len(parts) != self.fields:
            return f"{len(parts)} fields"
        wrong = [i for i in self.whole if i >= len(parts) or not _is_whole(parts[i])]
        return f"field {wrong[0]} is no whole number" if wrong else None


def _is_whole(text: str) -> bool:
    text = text.strip()
    return text.lstrip("+-").isdecimal() and len(text) - len(text.lstrip("+-")) <= 1


class TooLarge(OSError):
    pass


class Bounded(io.RawIOBase):
    """A stream that ends in an error beyond so many bytes, whatever an archive's directory says of its size."""

    def __init__(self, stream, most: int):
        self.stream, self.left = stream, most

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        self.left -= len(data)
        if self.left < 0:
            raise TooLarge("more bytes than allowed")
        buffer[: len(data)] = data
        return len(data)


def read_archives(spark: SparkSession, path: str, fields: int = 12, whole: tuple[int, ...] = (0, 6, 8), most_bytes: int = 1 << 30, header: str = "") -> DataFrame:
    """Lines of the bar archives in a folder, checked: 12 fields, of which the times and the number of trades are whole,
    below the given header, if there is one."""
    spark.dataSource.register(ArchiveSource)
    r = spark.read.format("flat_archives").option("fields", str(fields)).option("whole", ",".join(map(str, whole))).option("most_bytes", str(most_bytes)).option("header", header)
    return r.load(path)
