"""Two record file formats and Spark data sources that read and write them.

Sorted runs hold (key, seq, value) entries in checked blocks with a sparse index, a
Bloom filter and a footer; logs hold checked records one after another.  Numbers are
little-endian.  A null value is a deletion and stored empty.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan, WriterCommitMessage

from cairn.errors import CorruptFile, KeyTooLong

#: Fixed values of the formats.
MAGIC, VERSION = 0x4B45594C54, 1
BLOCK_BYTES = 16 * 1024
BLOOM_BYTES, KEY_BYTES = 16_384, (1 << 16) - 1
ENTRY, INDEXED, RECORD, FOOTER = struct.Struct("<HI"), struct.Struct("<HQ"), struct.Struct("<QHI"), struct.Struct("<QIQQQQQ")

Row = tuple[bytes, int, bytes | None]


def checked(body: bytes) -> bytes:
    return struct.pack("<I", len(body)) + body + struct.pack("<I", zlib.crc32(body))


def unchecked(data: bytes, at: int) -> tuple[bytes, int]:
    (size,) = struct.unpack_from("<I", data, at)
    body = data[at + 4 : at + 4 + size]
    if len(body) < size or zlib.crc32(body) != struct.unpack_from("<I", data, at + 4 + size)[0]:
        raise CorruptFile(f"block at {at} doesn't have its checksum")
    return body, at + 8 + size


def bloom_bits(key: bytes, bits: int = 8 * BLOOM_BYTES) -> tuple[int, int, int]:
    """Two CRC-32s, seeded with four bytes, and their sum."""
    one, two = (zlib.crc32(key, zlib.crc32(struct.pack("<I", seed))) for seed in (0, 1))
    return one % bits, two % bits, (one + two) % bits


def write_run(rows: Iterable[Row]) -> bytes:
    """A run of rows, which come sorted by key and falling sequence number."""
    out, block, index, bloom, seqs, first = bytearray(), bytearray(), [], bytearray(BLOOM_BYTES), [], None
    for key, seq, value in rows:
        if len(key) > KEY_BYTES:
            raise KeyTooLong(f"a run's keys have {KEY_BYTES} bytes at most, this one {len(key)}")
        if first is None:
            first = key
        block += ENTRY.pack(len(key), len(value or b"")) + key + struct.pack("<Q", seq) + (value or b"")
        for bit in bloom_bits(key):
            bloom[bit >> 3] |= 1 << (bit & 7)
        seqs.append(seq)
        if len(block) >= BLOCK_BYTES:
            index.append((first, len(out)))
            out += checked(bytes(block))
            block, first = bytearray(), None
    if block:
        index.append((first, len(out)))
        out += checked(bytes(block))
    index_at = len(out)
    out += checked(struct.pack("<I", len(index)) + b"".join(INDEXED.pack(len(k), at) + k for k, at in index))
    bloom_at = len(out)
    out += checked(bytes(bloom))
    return bytes(out + FOOTER.pack(MAGIC, VERSION, index_at, bloom_at, len(seqs), min(seqs, default=0), max(seqs, default=0)))


class Run:
    """A run's footer, index and filter; blocks are read and parsed when they are asked
    for.  ``source`` is the file's bytes, or an open file that is read in ranges."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = source
        size = len(source) if isinstance(source, bytes) else source.size()
        if size < FOOTER.size:
            raise CorruptFile("too short for a run")
        magic, version, index_at, bloom_at, self.entries, self.min_seq, self.max_seq = FOOTER.unpack(self._read(size - FOOTER.size, size))
        if magic != MAGIC or version != VERSION:
            raise CorruptFile("not a run")
        body, _ = unchecked(self._read(index_at, bloom_at), 0)
        self.bloom, _ = unchecked(self._read(bloom_at, size - FOOTER.size), 0)
        at, self.firsts, self.places = 4, [], []
        for _ in range(struct.unpack_from("<I", body)[0]):
            size, place = INDEXED.unpack_from(body, at)
            at += INDEXED.size + size
            self.firsts.append(body[at - size : at])
            self.places.append(place)
        self.ends = [*self.places[1:], index_at]

    def _read(self, at: int, end: int) -> bytes:
        return self.source[at:end] if isinstance(self.source, bytes) else self.source.read_at(end - at, at)

    def block(self, i: int) -> Iterator[Row]:
        body, _ = unchecked(self._read(self.places[i], self.ends[i]), 0)
        at = 0
        while at < len(body):
            size, length = ENTRY.unpack_from(body, at)
            at += ENTRY.size
            key = body[at : at + size]
            (seq,) = struct.unpack_from("<Q", body, at + size)
            at += size + 8 + length
            yield key, seq, body[at - length : at] or None

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(key, 8 * len(self.bloom)))

    def rows(self, start: bytes | None = None, end: bytes | None = None) -> Iterator[Row]:
        """Entries with start <= key < end; blocks outside aren't touched."""
        # versions of one key may begin in the block before the one whose first key it is
        first = 0 if start is None else max(0, bisect_right(self.firsts, start) - 1)
        while first and start is not None and self.firsts[first] == start:
            first -= 1
        for i in range(first, len(self.places)):
            if end is not None and self.firsts[i] >= end:
                return
            for row in self.block(i):
                if (start is None or row[0] >= start) and (end is None or row[0] < end):
                    yield row

    def get(self, key: bytes, before: int | None = None) -> Row | None:
        """The newest version, a deletion too, with a sequence number under ``before``."""
        if not self.may_have(key) or (before is not None and before <= self.min_seq):
            return None
        found = (r for r in self.rows(key, key + b"\0") if before is None or r[1] < before)
        return max(found, key=lambda r: r[1], default=None)


def log_record(key: bytes, seq: int, value: bytes | None) -> bytes:
    if len(key) > KEY_BYTES:
        raise KeyTooLong(f"a log's keys have {KEY_BYTES} bytes at most, this one {len(key)}")
    body = RECORD.pack(seq, len(key), len(value or b"")) + key + (value or b"")
    return body + struct.pack("<I", zlib.crc32(body))


def read_log(data: bytes) -> Iterator[Row]:
    """Records in order.  A header cut short ends the log; anything else amiss raises."""
    at = 0
    while at + RECORD.size <= len(data):
        seq, size, length = RECORD.unpack_from(data, at)
        stop = at + RECORD.size + size + length
        if stop + 4 > len(data) or zlib.crc32(data[at:stop]) != struct.unpack_from("<I", data, stop)[0]:
            raise CorruptFile(f"record at {at} is damaged")
        key = data[at + RECORD.size : at + RECORD.size + size]
        yield key, seq, data[stop - length : stop] or None
        at = stop + 4


# ---- data sources ----------------------------------------------------------


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


@dataclass
class FilePart(InputPartition):
    path: str


BATCH_ROWS = 8192
SCHEMA = pa.schema([("key", pa.binary()), ("seq", pa.int64()), ("value", pa.binary())])


class _Reader(DataSourceReader):
    def __init__(self, path: str, runs: bool):
        self.path, self.runs, self.start, self.end, self.keys, self.before = path, runs, None, None, [], None

    def pushFilters(self, filters: list[Filter]):
        """Bounds on the key reach the run's index, single keys its Bloom filter and upper
        bounds on the sequence number its footer; everything is checked again."""
        for f in filters:
            if self.runs and isinstance(f, (EqualTo, GreaterThanOrEqual, LessThan)) and f.attribute == ("key",):
                value = bytes(f.value)
                if isinstance(f, EqualTo):
                    self.keys.append(value)
                if isinstance(f, (GreaterThanOrEqual, EqualTo)):
                    self.start = max(self.start or b"", value)
                if isinstance(f, (LessThan, EqualTo)):
                    value += b"\0" if isinstance(f, EqualTo) else b""
                    self.end = value if self.end is None else min(self.end, value)
            elif self.runs and isinstance(f, LessThan) and f.attribute == ("seq",):
                self.before = f.value if self.before is None else min(self.before, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _fs(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [FilePart(self.path)]
        base = self.path.rstrip("/")
        return [FilePart(f"{base}/{os.path.basename(p)}") for p in sorted(_files(fs, path, self.runs))]

    def _rows(self, file: pa.NativeFile) -> Iterator[Row]:
        if not self.runs:
            return read_log(file.read())
        run = Run(file)
        if (self.before is not None and run.min_seq >= self.before) or not all(map(run.may_have, self.keys)):
            return iter(())
        return run.rows(self.start, self.end)

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(partition.path)
        with fs.open_input_file(path) as file:
            rows = self._rows(file)
            while some := list(islice(rows, BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def _files(fs: pafs.FileSystem, path: str, runs: bool) -> list[str]:
    suffix = ".db" if runs else ".log"
    return [i.path for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.path.endswith(suffix)]


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceWriter):
    """A file for each partition; those of a run are sorted before they are written.

    Tasks write under names that no reader lists; the driver's commit gives the files of
    the attempts that count their names, so a repeated or failed task adds nothing.
    """

    def __init__(self, path: str, runs: bool, overwrite: bool):
        self.path, self.runs, self.overwrite = path, runs, overwrite

    def write(self, rows: Iterator) -> Written:
        found = [(bytes(r["key"]), r["seq"], None if r["value"] is None else bytes(r["value"])) for r in rows]
        if not found:
            return Written(None)
        found.sort(key=lambda r: (r[0], -r[1]) if self.runs else r[1])
        data = write_run(found) if self.runs else b"".join(log_record(*r) for r in found)
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        name = f"sst-{uuid.uuid4().hex}.db" if self.runs else f"wal-{uuid.uuid4().hex}.log"
        with fs.open_output_stream(f"{path}/{name}.part", compression=None) as out:
            out.write(data)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        old = _files(fs, path, self.runs) if self.overwrite else []
        for name in (m.name for m in messages if m and m.name):
            fs.move(f"{path}/{name}.part", f"{path}/{name}")
        for file in old:
            fs.delete_file(file)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _fs(self.path)
        for name in (m.name for m in messages if m and m.name):
            fs.delete_file(f"{path}/{name}.part")


class SortedRuns(DataSource):
    """``format("cairn_runs")``"""

    runs = True

    @classmethod
    def name(cls) -> str:
        return "cairn_runs"

    def schema(self) -> str:
        return "key binary, seq bigint, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.runs)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.runs, overwrite)


class RecordLogs(SortedRuns):
    """``format("cairn_log")``"""

    runs = False

    @classmethod
    def name(cls) -> str:
        return "cairn_log"


def register(spark: SparkSession) -> None:
    """Make both formats known; with pushdown of bounds on the key."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SortedRuns)
    spark.dataSource.register(RecordLogs)
