"""Logs that grow: a streaming source over files to which lines are appended.

Spark's file source takes a file once, as it is when it is first seen. This one keeps a byte offset
per file. An offset always lies behind a newline, so a line that is still being written stays back
until its newline comes; a batch that is run again reads the same bytes. The bytes of a long file
are cut into parts for several tasks, each taking the lines that begin in its part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship

STEP = 1 << 16
LINES = "path string, offset long, value string"
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("value", pa.string())])
_BATCH_LINES = 5000


@dataclass
class Part(InputPartition):
    """The lines of one file that begin at or behind ``first`` and before ``last``."""

    path: str
    first: int
    last: int
    end: int


def last_newline(file: pa.NativeFile, first: int, end: int) -> int:
    """The place behind the last newline of the bytes from ``first`` to ``end``, or ``first``."""
    at = end
    while at > first:
        begin = max(first, at - STEP)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return first


def lines_of(file: pa.NativeFile, part: Part) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines of a part."""
    at, held = part.first, b""
    if at > 0:  # a line that began earlier belongs to the part before; look for its newline one byte back
        at -= 1
    file.seek(at)
    skip = part.first > 0
    while at + len(held) < part.end:
        block = file.read(min(STEP, part.end - at - len(held)))
        if not block:
            return
        *whole, held = (held + block).split(b"\n")
        for line in whole:
            if skip:
                skip = False
            elif at >= part.last:
                return
            else:
                yield at, line
            at += len(line) + 1
        if at >= part.last and not skip:
            return


class GrowingLogReader(DataSourceStreamReader):
    """Offsets are ``{path: [crc of the first line, bytes]}``; another first line is another log."""

    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.part_bytes = int(options.get("partBytes", 64 << 20))
        self.known: dict[str, tuple[int, list[int]]] = {}

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = self._open()
        offsets = {}
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            inner = info.path[len(root) :].strip("/").split("/")
            if info.type != fs.FileType.File or any(p.startswith(("_", ".")) for p in inner) or not info.path.endswith(self.suffix):
                continue
            size, offset = self.known.get(info.path, (-1, None))
            if info.size != size:
                offset = self._complete(store, info.path, info.size, offset)
                self.known[info.path] = info.size, offset
            if offset[1] > 0:
                offsets[info.path] = offset
        return offsets

    @staticmethod
    def _complete(store: fs.FileSystem, path: str, size: int, before: list[int] | None) -> list[int]:
        with store.open_input_file(path) as file:
            head = bytearray()
            while b"\n" not in head and len(head) < size:
                block = file.read(min(STEP, size - len(head)))
                if not block:
                    break
                head += block
            first = head.find(b"\n")
            if first < 0:
                return [0, 0]
            crc = zlib.crc32(bytes(head[:first]))
            known = before[1] if before and before[0] == crc and before[1] <= size else 0
            return [crc, max(last_newline(file, known, size), first + 1)]

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for path, (crc, last) in sorted(end.items()):
            before = start.get(path)
            first = before[1] if before and before[0] == crc else 0
            for at in range(first, last, self.part_bytes):
                parts.append(Part(path, at, min(at + self.part_bytes, last), last))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        rows: list[tuple[int, str]] = []

        def batch() -> pa.RecordBatch:
            columns = [partition.path] * len(rows), [r[0] for r in rows], [r[1] for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        with store.open_input_file(partition.path) as file:
            for offset, line in lines_of(file, partition):
                rows.append((offset, line.removesuffix(b"\r").decode("utf-8", errors="replace")))
                if len(rows) >= _BATCH_LINES:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    def commit(self, end: dict) -> None:
        """Nothing to do: files are never removed."""


class GrowingLog(DataSource):
    """``spark.readStream.format("growing_log").load(folder)``: (path, offset, value) of each whole line.

    Options: ``suffix`` of the files to follow, ``partBytes`` of one task. The folder may be in any
    store that Arrow reads; names that begin with ``_`` or ``.`` are left out. The offset of a
    stream has one entry per file.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(self.options)


def read_growing(spark: SparkSession, path: str, *, suffix: str = "", part_bytes: int = 64 << 20) -> DataFrame:
    """A stream of the whole lines of all files in a folder, as they are appended."""
    ship(spark)
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").option("suffix", suffix).option("partBytes", part_bytes).load(path)
