"""``raw-lines``: a data source of (source_file, source_offset, raw) with each line's own bytes, in batches and as a stream.

Files are read in splits at line ends, through a file system that the path's scheme names, so a
large file is many tasks. As a stream, files that grow and new files give their finished lines;
a line without its end waits for it. Lines come without the newline, a carriage return kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_file string, source_offset long, raw binary"
NAMES = ["source_file", "source_offset", "raw"]
SPLIT_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
#: Splits that a task reads one after the other hold this many bytes, so that small ones don't make a task each; what is first read
#: for a line that goes on beyond a split's end, then twice as much each time.
TASK_BYTES, BEYOND_BYTES = 16 << 20, 64 << 10


@dataclass
class Split(InputPartition):
    """The lines of a file that begin in [start, end); ``last`` is where the file's finished part ends."""

    path: str
    start: int
    end: int
    last: int


@dataclass
class Splits(InputPartition):
    """Splits that one task reads in turn."""

    splits: list[Split]


def _tasks(splits: list[Split]) -> list[Splits]:
    """Splits dealt to tasks in order, some :data:`TASK_BYTES` each; a larger split is a task."""
    tasks, size = [], TASK_BYTES
    for split in splits:
        if size >= TASK_BYTES:
            tasks.append(Splits([]))
            size = 0
        tasks[-1].splits.append(split)
        size += split.end - split.start
    return tasks


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> dict[str, int]:
    """The size of each file at or below ``path``, by its name there; hidden and marker files aside."""
    system, root = _opened(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    below = lambda p: p[len(root) :].strip("/").split("/")
    return {prefix + f.path: f.size for f in found if f.is_file and not any(part.startswith((".", "_")) for part in below(f.path))}


def _splits(path: str, start: int, last: int, size: int) -> list[Split]:
    return [Split(path, at, min(last, at + size), last) for at in range(start, last, size)]


def _finished(path: str, size: int, known: int) -> int:
    """Where the last newline before ``size`` ends, looked for backwards; ``known`` if there is none after it."""
    system, name = _opened(path)
    with system.open_input_file(name) as file:
        at = size
        while at > known:
            low = max(known, at - CHUNK_BYTES)
            found = file.read_at(at - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return known


def lines_of(split: Split, chunk: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The split's lines; of a chunk at a time, and of one line where it is longer, the bytes are held."""
    system, name = _opened(split.path)
    with system.open_input_file(name) as file:
        at, rest, step = split.start, [], BEYOND_BYTES
        if at and file.read_at(1, at - 1) != b"\n":  # the line before goes on into this split, and is that one's
            while at < split.last:
                data = file.read_at(min(chunk, split.last - at, step), at)
                step *= 2
                found = data.find(b"\n")
                at += found + 1 if found >= 0 else len(data)
                if found >= 0:
                    break
        begin = at  # of the first line that is not given yet
        while begin < split.end and at < split.last:
            data = file.read_at(min(chunk, split.last - at, max(split.end - at, step)), at)
            at += len(data)
            step *= 2
            if b"\n" not in data and at < split.last:
                rest.append(data)
                continue
            data = b"".join([*rest, data])
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10).astype(np.int64)
            if at == split.last and len(data) and data[-1:] != b"\n":
                ends = np.r_[ends, len(data)]
            starts = np.r_[0, ends[:-1] + 1]
            mine = starts + begin < split.end
            starts, ends = starts[mine], ends[mine]
            offsets = pa.array(begin + starts)
            yield pa.RecordBatch.from_arrays([pa.array([split.path] * len(starts)), offsets, pa.array([data[a:b] for a, b in zip(starts, ends)], pa.binary())], NAMES)
            if not mine.all() or not len(ends):
                return
            rest, begin = [data[ends[-1] + 1 :]], begin + int(ends[-1]) + 1


class RawLines(DataSource):
    """``spark.read.format("raw-lines").load(path)``; the option ``splitBytes`` bounds a split."""

    @classmethod
    def name(cls) -> str:
        return "raw-lines"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES)))

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options["path"], self._size())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._size())


class _BatchReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Splits]:
        return _tasks([s for name, last in sorted(_files(self.path).items()) for s in _splits(name, 0, last, self.size)])

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        for split in partition.splits if partition else ():
            yield from lines_of(split)


class _StreamReader(DataSourceStreamReader):
    """Offsets are how far each file has been read; they grow with the number of files."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.ends = path, size, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for name, size in _files(self.path).items():
            if size > self.ends.get(name, 0):
                self.ends[name] = _finished(name, size, self.ends.get(name, 0))
        return {name: end for name, end in sorted(self.ends.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[Splits]:
        return _tasks([s for name, last in sorted(end.items()) for s in _splits(name, start.get(name, 0), last, self.size)])

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        for split in partition.splits if partition else ():
            yield from lines_of(split)

    def commit(self, end: dict) -> None:
        self.ends |= end


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawLines)


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(source_file, source_offset, raw): the bytes of every line at or below ``path``; a last line needs no end."""
    register(spark)
    return spark.read.format("raw-lines").option("splitBytes", split_bytes).load(path)


def stream_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same as a stream of the lines that are finished."""
    register(spark)
    return spark.readStream.format("raw-lines").option("splitBytes", split_bytes).load(path)


def text_of(raw: Column) -> Column:
    """The bytes as text; each ill-formed part of UTF-8 reads as U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))
