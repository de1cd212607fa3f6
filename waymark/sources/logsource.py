"""Append-only logs as a data source of their own: a partition for each range of a log's bytes, and offsets for streams.

register(spark), then spark.read or spark.readStream with format("logs") and load(folder). Each file is one repository's
log, named after it; folder is a path or address that Arrow's file systems read (local, HDFS, S3).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "repo string, n bigint, line string"
ARROW = pa.schema([("repo", pa.string()), ("n", pa.int64()), ("line", pa.string())])
#: Bytes of a partition, and of a read.
RANGE, BLOCK = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """The lines of a log that begin at bytes from first on, before end."""

    path: str
    first: int
    end: int


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def sizes(folder: str) -> dict[str, int]:
    """Bytes of every log of a folder, by its path; files whose names begin with a dot or _ are none."""
    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"}


def ranges(start: dict[str, int], end: dict[str, int], most: int) -> list[Range]:
    return [Range(path, at, min(at + most, size)) for path, size in sorted(end.items()) for at in range(start.get(path, 0), size, most)]


def finished(folder: str) -> dict[str, int]:
    """Bytes of every log up to the end of its last whole line."""
    system, _ = opened(folder)
    out = {}
    for path, size in sizes(folder).items():
        with system.open_input_file(path) as f:
            at = size
            while at > 0:
                low = max(0, at - BLOCK)
                cut = f.read_at(at - low, low).rfind(b"\n")
                if cut >= 0:
                    out[path] = low + cut + 1
                    break
                at = low
    return out


def lines(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place of its first byte, line) of the lines that begin in a range. A range that begins within a line leaves the rest
    of that line to the range before; a line that goes on past the end is read to its own end."""
    with system.open_input_file(part.path) as f:
        at, held = part.first, b""
        if at:
            within = f.read_at(1, at - 1) != b"\n"
        else:
            within = False
        place = at
        while True:
            block = f.read_at(BLOCK, at)
            at += len(block)
            pieces = (held + block).split(b"\n")
            held = pieces.pop()
            for piece in pieces:
                if place >= part.end:
                    return
                if not within:
                    yield place, piece
                within = False
                place += len(piece) + 1
            if place >= part.end:
                return
            if not block:
                if held and not within:
                    yield place, held
                return


def batches(folder: str, part: Range) -> Iterator[pa.RecordBatch]:
    system, _ = opened(folder)
    repo = part.path.rsplit("/", 1)[-1].removesuffix(".log")
    held: list[tuple[int, str]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array([repo] * len(held)), pa.array([n for n, _ in held], pa.int64()), pa.array([x for _, x in held], pa.string())], schema=ARROW)

    for n, line in lines(system, part):
        held.append((n, line.decode("utf-8", "replace").removesuffix("\r")))
        size += len(line)
        if size >= BLOCK or len(held) >= 10_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Range]:
        return ranges({}, sizes(self.folder), self.most) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(self.folder, partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are bytes read, by log. A line counts once its end is written."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {"read": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"read": json.dumps(finished(self.folder), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(json.loads(start["read"]), json.loads(end["read"]), self.most)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(self.folder, partition)


class LogSource(DataSource):
    """(repo, n, line) of the logs in a folder: n is the place of the line's first byte, so lines are in order of n. A last
    line without an end is read in a batch, and waited for in a stream. Option rangeBytes: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "logs"

    def schema(self) -> str:
        return SCHEMA

    def _of(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("rangeBytes", RANGE))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._of())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._of())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
