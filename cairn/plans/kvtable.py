"""A versioned key-value table and its transactions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import TransactionClosed
from cairn.operators import versions
from cairn.sources.segments import SegmentStore

#: Bytes of single writes that the driver holds before they become a segment.
BUFFER_BYTES = 1 << 20
#: Segments after which writes compact.
COMPACT_AT = 8


def as_bytes(value: str | bytes | None) -> bytes | None:
    return value.encode() if isinstance(value, str) else value


class KVTable:
    """Newest version wins; an empty value deletes; reads may be as of a sequence
    number, exclusive.  Single writes gather on the driver up to ``BUFFER_BYTES`` and
    are durable from ``flush`` on; DataFrames are written as they come.
    """

    def __init__(self, spark: SparkSession, path: str, auto_compact: bool = False):
        self.spark, self.store = spark, SegmentStore(spark, path)
        self.pending: list[tuple[bytes, int, bytes | None]] = []
        self.held, self.seq, self.auto = 0, self.store.next_seq, auto_compact

    # -- writing

    def put(self, key: str | bytes, value: str | bytes | None) -> int:
        key, value = as_bytes(key), as_bytes(value) or None
        seq, self.seq = self.seq, self.seq + 1
        self._hold([(key, seq, value)])
        return seq

    def delete(self, key: str | bytes) -> int:
        return self.put(key, None)

    def _hold(self, rows: list[tuple[bytes, int, bytes | None]]) -> None:
        self.pending += rows
        self.held += sum(len(k) + len(v or b"") + 8 for k, _, v in rows)
        if self.held >= BUFFER_BYTES:
            self.flush()

    def put_all(self, rows: DataFrame) -> int:
        """Write a DataFrame (key, value) in one commit at one sequence number."""
        self.flush()
        rows = rows.select(F.col("key").cast("binary").alias("key"), versions.erased(F.col("value").cast("binary")).alias("value"))
        seq = self.store.append_at_once(versions.last_writes(rows.withColumn("op", F.monotonically_increasing_id())))
        self.seq = self.store.next_seq
        return seq

    def delete_prefix(self, prefix: str | bytes) -> int:
        self.flush()
        seq = self.store.next_seq
        self.store.append(versions.without_prefix(self.log(), as_bytes(prefix), seq), seq + 1)
        self.seq = self.store.next_seq
        return seq

    def delete_range(self, start: str | bytes | None, end: str | bytes | None) -> int:
        self.flush()
        seq = self.store.next_seq
        self.store.append(versions.without_range(self.log(), as_bytes(start), as_bytes(end), seq), seq + 1)
        self.seq = self.store.next_seq
        return seq

    def flush(self) -> None:
        if self.pending:
            self.store.append(self.spark.createDataFrame(self.pending, self.store.schema), self.seq)
            self.pending, self.held = [], 0
            if self.auto and len(self.store.state["segments"]) >= COMPACT_AT:
                self.compact()

    def compact(self, retain: int | None = None) -> None:
        """Rewrite the log as ``versions.compact`` leaves it."""
        self.flush()
        self.store.replace(versions.compact(self.store.log(), retain))

    def close(self) -> None:
        self.flush()

    # -- reading

    def log(self) -> DataFrame:
        stored = self.store.log()
        return stored.unionByName(self.spark.createDataFrame(self.pending, self.store.schema)) if self.pending else stored

    def get(self, key: str | bytes, before: int | None = None) -> bytes | None:
        row = versions.get(self.log(), as_bytes(key), before).first()
        return None if row is None else bytes(row["value"])

    def scan(self, start: str | bytes | None = None, end: str | bytes | None = None, before: int | None = None) -> DataFrame:
        """key, value of the live entries, by key; start inclusive, end exclusive."""
        return versions.scan(self.log(), as_bytes(start), as_bytes(end), before).select("key", "value").orderBy("key")

    def scan_prefix(self, prefix: str | bytes, before: int | None = None) -> DataFrame:
        return versions.scan_prefix(self.log(), as_bytes(prefix), before).select("key", "value").orderBy("key")

    def items(self, **where) -> Iterator[tuple[bytes, bytes]]:
        """Entries one partition at a time."""
        for row in self.scan(**where).toLocalIterator():
            yield bytes(row["key"]), bytes(row["value"])

    def stats(self) -> DataFrame:
        return versions.segment_stats(self.store.log(), F.regexp_extract(F.col("_metadata.file_path"), r"segments/([0-9a-f]+)", 1))

    def begin(self) -> KVTransaction:
        return KVTransaction(self)


class KVTransaction:
    """Reads a snapshot under its own buffer; commits all of it at one new sequence
    number.  No conflicts are looked for: the last to commit wins.  After commit or
    abort the transaction is closed.
    """

    def __init__(self, table: KVTable):
        self.table, self.snapshot = table, table.seq
        self.buffer: dict[bytes, bytes | None] | None = {}

    def _open(self) -> dict[bytes, bytes | None]:
        if self.buffer is None:
            raise TransactionClosed("this transaction has ended")
        return self.buffer

    def put(self, key: str | bytes, value: str | bytes | None) -> None:
        self._open()[as_bytes(key)] = as_bytes(value) or None

    def delete(self, key: str | bytes) -> None:
        self.put(key, None)

    def get(self, key: str | bytes) -> bytes | None:
        key = as_bytes(key)
        return self.buffer[key] if key in self._open() else self.table.get(key, self.snapshot)

    def scan(self, start: str | bytes | None = None, end: str | bytes | None = None) -> DataFrame:
        start, end = as_bytes(start), as_bytes(end)
        buffered = versions.between(self.table.spark.createDataFrame(list(self._open().items()), "key binary, value binary"), start, end)
        base = versions.scan(self.table.log(), start, end, self.snapshot)
        return versions.overlay(base, buffered).orderBy("key")

    def commit(self) -> int | None:
        """All writes at one sequence number, published by one manifest before this
        returns; on a failure none are there and the transaction is still open."""
        rows = self._open()
        if not rows:
            self.buffer = None
            return None
        self.table.flush()
        seq = self.table.seq
        self.table.store.append(self.table.spark.createDataFrame([(k, seq, v) for k, v in rows.items()], self.table.store.schema), seq + 1)
        self.table.seq, self.buffer = seq + 1, None
        return seq

    def abort(self) -> None:
        self._open()
        self.buffer = None
