"""Text files by byte offsets: a batch source whose lines are numbered in one scan, and a stream that follows growing files.

A line's number (file_line) is the offset of its first byte. It orders a file's lines and is the same however the file is
cut into tasks, so that numbering needs neither a second scan nor a join.

The stream reads what is appended to the files of a folder (or of a glob on their names), each complete line once. Its
offset says how far each file goes and what tells the file apart: its first line's hash and, on local disks, its inode.
Between two offsets

- a file that is still the same is read on from where it was left,
- a file that is shorter than it was, or begins with another line, was truncated or replaced: it is read from the start,
- a file that is new under its name but is known under one that it has no more was renamed (rotated): it is read on.

Offsets depend on the files alone, so a restarted stream goes on from its checkpoint. A last line without an end waits for
it. Lines that go before the stream has looked at them (truncated within one trigger) are lost. Compressed files are read
in batch only. The folder must be reachable from the driver and the executors, by any file system of pyarrow's.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
FIRST_BYTES = 4096
PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}

SCHEMA = StructType([StructField("log_path", StringType()), StructField("file_line", LongType()), StructField("value", StringType())])


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [begin, end). limit: no byte from it on is read; identity: '' if it doesn't matter."""

    path: str
    begin: int
    end: int
    limit: int
    first: bool
    identity: str = ""


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file system and the files of a folder, a file, or a folder with a glob as last part, by name."""
    system, place = _system(path)
    folder, name = place.rsplit("/", 1)
    if not set(name) & set("*?["):
        info = system.get_file_info(place)
        if info.type == fs.FileType.File:
            return system, [info]
        folder, name = place, "*"
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return system, sorted((x for x in found if x.is_file and x.base_name[0] not in "._" and fnmatch.fnmatch(x.base_name, name)), key=lambda x: x.path)


def _packing(path: str) -> str | None:
    return PACKED.get(os.path.splitext(path)[1])


def _identity(system: fs.FileSystem, path: str) -> str:
    """What tells a file apart, '' while it has no complete first line."""
    with system.open_input_file(path) as f:
        head = f.read(FIRST_BYTES)
    line, end, _ = head.partition(b"\n")
    if not end and len(head) < FIRST_BYTES:
        return ""
    inode = f"{os.stat(path).st_ino}-" if isinstance(system, fs.LocalFileSystem) else ""
    return inode + hashlib.sha256(line).hexdigest()[:24]


def _line_end(system: fs.FileSystem, path: str, size: int) -> int:
    """Where the last complete line of the first `size` bytes ends."""
    with system.open_input_file(path) as f:
        end = min(size, f.size())
        while end > 0:
            begin = max(0, end - FIRST_BYTES)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def _cut(path: str, begin: int, end: int, limit: int, split: int, identity: str = "") -> list[Range]:
    return [Range(path, at, min(end, at + split), limit, at == begin, identity) for at in range(begin, end, split)]


def _batch(path: str, lines: list[bytes], begin: int) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    places = begin + np.cumsum(sizes) - sizes
    texts = [x[:-1] if x.endswith(b"\r") else x for x in lines]
    try:
        values = pa.array(texts, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        values = pa.array([x.decode("utf-8", "replace") for x in texts])
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(places), values], schema=pa.schema([("log_path", pa.string()), ("file_line", pa.int64()), ("value", pa.string())]))


def _lines(path: str, read, at: int, end: int, skip: bool) -> Iterator[pa.RecordBatch]:
    """The lines that begin in [at, end). read(n): the next bytes from `at` on, none at the end; skip: `at` is within a line."""
    rest = b""
    while at < end:
        data = read(min(READ_BYTES, max(end - at - len(rest), len(rest), 4096)))  # no more than the piece and its last line
        pieces = (rest + data).split(b"\n")
        rest = pieces.pop() if data else b""
        if not data and pieces[-1] == b"":
            pieces.pop()  # nothing after the last line's end
        if skip and pieces:
            at += len(pieces.pop(0)) + 1
            skip = False
        if pieces:
            starts = at + np.concatenate(([0], np.cumsum([len(x) + 1 for x in pieces])))
            wanted = int(np.searchsorted(starts[:-1], end))
            if wanted:
                yield _batch(path, pieces[:wanted], at)
            at = int(starts[-1])
        if not data:
            return


class Lines(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.split = options["path"].split(","), int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            for x in _files(path)[1]:
                out += [Range(x.path, 0, 1 << 62, 1 << 62, True)] if _packing(x.path) else _cut(x.path, 0, x.size, 1 << 62, self.split)
        return out or [Range("", 0, 0, 0, True)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from _read(part, self.paths[0])


def _read(part: Range, like: str) -> Iterator[pa.RecordBatch]:
    system, _ = _system(like)
    if packing := _packing(part.path):
        with system.open_input_stream(part.path, compression=packing) as f:
            yield from _lines(part.path, f.read, 0, part.end, False)
        return
    with system.open_input_file(part.path) as f:
        at = part.begin if part.first else part.begin - 1  # a line that begins right here is this task's
        f.seek(at)
        yield from _lines(part.path, lambda n: f.read(max(0, min(n, part.limit - f.tell()))), at, part.end, not part.first)


class Growing(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, files = _files(self.path)
        out = {}
        for x in files:
            identity = "" if _packing(x.path) else _identity(system, x.path)
            if identity:
                out[x.path] = {"identity": identity, "end": _line_end(system, x.path, x.size)}
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        gone = {x["identity"]: x["end"] for path, x in start.items() if end.get(path, {}).get("identity") != x["identity"]}
        out = []
        for path, x in end.items():
            same = start.get(path, {}).get("identity") == x["identity"]
            begin = start[path]["end"] if same else gone.get(x["identity"], 0)
            if begin > x["end"]:  # shorter than it was
                begin = 0
            out += _cut(path, begin, x["end"], x["end"], self.split, x["identity"])
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        for path in chain([part.path], (x.path for x in _files(self.path)[1])):  # it may have been renamed since the trigger
            if system.get_file_info(path).is_file and _identity(system, path) == part.identity:
                moved = Range(path, part.begin, part.end, part.limit, part.first)
                for batch in _read(moved, self.path):
                    yield batch.set_column(0, "log_path", pa.array([part.path] * batch.num_rows))
                return


class TextByOffset(DataSource):
    """Options: path (a file, a folder, or a folder with a glob as last part; several by commas in batch), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "text_by_offset"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> Lines:
        return Lines(dict(self.options))

    def streamReader(self, schema: StructType) -> Growing:
        return Growing(dict(self.options))


def read_lines(spark: SparkSession, *paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(log_path, file_line, value): the lines of files, in one scan; compressed files by their extension."""
    spark.dataSource.register(TextByOffset)
    return spark.read.format("text_by_offset").option("path", ",".join(paths)).option("splitBytes", split_bytes).load()


def follow(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(log_path, file_line, value): a stream of the lines that the files of a folder have and get."""
    spark.dataSource.register(TextByOffset)
    return spark.readStream.format("text_by_offset").option("path", path).option("splitBytes", split_bytes).load()
