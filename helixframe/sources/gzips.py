"""Lines of gzip files without a copy: a blocked file (BGZF) is read by many tasks, any other by one.

A blocked file is a row of gzip members of at most 64 KB whose headers tell their lengths, so a
task can start at the first member that begins in its byte range. As with plain text, a range
begins after the first line end at or beyond its first block and ends after the first one at or
beyond the next range's, so each line is read once, whole, whatever blocks it crosses.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The bytes that gzip files, and members with extra fields, begin with; the field that tells a block's length (fixed values).
GZIP, EXTRA, LENGTH = b"\x1f\x8b", b"\x1f\x8b\x08\x04", b"BC"
#: Greatest length of a block (fixed value).
MOST = 1 << 16
#: Compressed bytes of a range.
RANGE = 16 << 20
#: Lines, and bytes of them, of a batch.
LINES, BYTES = 1 << 13, 4 << 20

SCHEMA = "file string, start long, nth long, value binary"


class NotBlocked(ValueError):
    """A member without a length where blocks were read."""


def opened(path: str) -> BinaryIO:
    if path.startswith("file:"):
        return open(re.sub("^file:/+", "/", path), "rb")
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def can_open(path: str) -> bool:
    """Whether tasks can open the path without the JVM."""
    if path.startswith("file:"):
        return True
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def block_length(data: bytes, at: int = 0) -> int | None:
    """The length that a block's header at ``at`` tells; None if no whole header of a block is there."""
    if data[at : at + 4] != EXTRA or len(data) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    k, end = at + 12, at + 12 + extra
    while k + 4 <= min(end, len(data)):
        (size,) = struct.unpack_from("<H", data, k + 2)
        if data[k : k + 2] == LENGTH and size == 2 and k + 6 <= len(data):
            return struct.unpack_from("<H", data, k + 4)[0] + 1
        k += 4 + size
    return None


def first_block(f: BinaryIO, size: int, at: int) -> int:
    """Where the first block at or beyond ``at`` begins: a header whose block unpacks and that another one or the end follows."""
    if at == 0:
        return 0
    f.seek(at)
    data = f.read(3 * MOST)
    k = data.find(EXTRA)
    while k >= 0:
        n = block_length(data, k)
        if n and k + n <= len(data) and (at + k + n == size or block_length(data, k + n)):
            try:
                zlib.decompress(data[k : k + n], 31)
                return at + k
            except zlib.error:
                pass  # the bytes of a header inside packed data
        k = data.find(EXTRA, k + 1)
    if at + len(data) < size:
        raise NotBlocked(f"no block within {len(data)} bytes of {at}")
    return size


def blocks(f: BinaryIO, size: int, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, unpacked bytes) of the blocks from ``at`` on; each one's checksum is verified."""
    f.seek(at)
    rest = b""
    while at < size:
        if len(rest) < MOST:
            rest += f.read(1 << 20)
        n = block_length(rest)
        if n is None:
            raise (EOFError if len(rest) < 18 else NotBlocked)(f"no whole block at {at}")
        if len(rest) < n:
            raise EOFError(f"the block at {at} is cut")
        yield at, zlib.decompress(rest[:n], 31)
        rest, at = rest[n:], at + n


class _Cut:
    """The place after the first line end of chunks that are taken one by one."""

    def __init__(self, end: re.Pattern[bytes]):
        self.end, self.open = end, False  # open: a CR ended the last chunk, and an LF may follow

    def take(self, raw: bytes) -> int | None:
        if self.open:
            return int(raw[:1] == b"\n")
        hit = self.end.search(raw)
        if hit and hit[0] == b"\r" and hit.end() == len(raw):
            self.open = True
            return None
        return hit.end() if hit else None


def range_chunks(f: BinaryIO, size: int, start: int, end: int, line_end: re.Pattern[bytes]) -> Iterator[bytes]:
    """The bytes of a range's lines."""
    at = first_block(f, size, start)
    if at >= end:
        return  # a long block of the range before covers this one
    skip, stop = (_Cut(line_end) if start else None), None
    for offset, raw in blocks(f, size, at):
        if not raw:
            continue
        low, high = 0, len(raw)
        if skip:
            found = skip.take(raw)
            low, skip = (high, skip) if found is None else (found, None)
        if offset >= end:
            stop = stop or _Cut(line_end)
            found = stop.take(raw)
            if found is not None:
                yield raw[low:found]
                return
        yield raw[low:high]


def split_lines(chunks: Iterator[bytes], line_end: re.Pattern[bytes]) -> Iterator[bytes]:
    """The lines of the chunks, without their ends."""
    parts: list[bytes] = []
    held = b""  # a CR at the end of a chunk: an LF may follow
    for raw in chunks:
        raw, held = held + raw, b""
        if raw.endswith(b"\r") and line_end.fullmatch(b"\r"):
            raw, held = raw[:-1], b"\r"
        *whole, last = line_end.split(raw)
        if whole:
            yield b"".join(parts) + whole[0]
            yield from whole[1:]
            parts = []
        parts.append(last)
    final = b"".join(parts)
    if final or held:
        yield final


class _Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files, self.step = json.loads(options["files"]), int(options.get("range", RANGE))
        self.end = options.get("ends")

    def partitions(self) -> list[InputPartition]:
        return [_Range(path, size, k, min(size, k + self.step)) for path, size in self.files for k in range(0, max(1, size), self.step)]

    def read(self, partition: Any) -> Iterator[pa.RecordBatch]:
        line_end = re.compile(re.escape(self.end.encode()) if self.end else rb"\r\n?|\n")
        with opened(partition.path) as f:
            head = f.read(1 << 12)
            if block_length(head):
                chunks = range_chunks(f, partition.size, partition.start, partition.end, line_end)
            elif partition.start:
                return  # only blocks can be told apart: the first range reads the whole file
            else:
                f.seek(0)
                whole = gzip.GzipFile(fileobj=f) if head[:2] == GZIP else f  # a name alone makes no gzip file
                chunks = iter(lambda: whole.read(1 << 20), b"")
            batch: list[bytes] = []
            nth = held = 0
            for line in split_lines(chunks, line_end):
                batch.append(line)
                held += len(line)
                if len(batch) >= LINES or held >= BYTES:
                    yield self._batch(partition, nth, batch)
                    nth, held, batch = nth + len(batch), 0, []
            if batch:
                yield self._batch(partition, nth, batch)

    @staticmethod
    def _batch(part: _Range, nth: int, lines: list[bytes]) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.array([part.path] * n, pa.string()), pa.array([part.start] * n, pa.int64()), pa.array(range(nth + 1, nth + n + 1), pa.int64()), pa.array(lines, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["file", "start", "nth", "value"])


class GzipLines(DataSource):
    """``spark.read.format("gzip_lines")``: options ``files`` (JSON of [path, bytes] pairs), ``ends``, ``range``."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options)


def gzip_lines(spark: SparkSession, files: list[tuple[str, int]], ends: str | None = None, step: int = RANGE) -> DataFrame:
    """(file, start, nth, value) of (path, bytes) pairs: each range's lines, numbered inside it from 1.

    A truncated or altered file fails the job, and so does one that begins in blocks and goes on without.
    An empty table for no files, empty files and files of empty members.
    """
    spark.dataSource.register(GzipLines)
    reader = spark.read.format("gzip_lines").option("files", json.dumps(files)).option("range", step)
    return (reader.option("ends", ends) if ends else reader).load()
