"""Shared plumbing of the training-data operators.

Intermediate results live in the folder that ``spark.checkpoint.dir`` names,
which all executors and the driver see.  Files a task writes itself get a fresh
random name and count only once a committed table refers to them, so a repeated
or speculative attempt leaves at most an unused file behind.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where
    that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the
    lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rest(spark: SparkSession) -> None:
    """Let every executor collect its garbage and give the memory back.  A heap that one
    step made large stays large in the next, which may need room outside it: direct
    buffers, codecs, Python workers.  One short task per core; it changes no result."""
    cores = spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, cores, 1, cores).select(collected.alias("done")).agg(F.count("done")).collect()


class Shelf:
    """Staged tables and folders that only serve until an operator returns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, name: str) -> str:
        self.paths.append(shared_dir(self.spark, name))
        return self.paths[-1]

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Let Spark drop the shuffle files of jobs whose results are staged; it does so
        when the driver collects its garbage, in two rounds: plans, then what they held.
        Executors then collect theirs."""
        for _ in range(2):
            gc.collect()
            time.sleep(0.2)  # Python's references end on another thread
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
        rest(self.spark)

    def clear(self) -> None:
        for path in self.paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths.clear()
        self.sweep()


#: Bytes of an Arrow batch between Spark and Python workers; a longer row is one alone.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, for this session and where it names no bound itself.
    Spark's own bound is a number of rows, and batches of that many whole texts are held
    by the JVM and the worker at once.  Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(name):
        spark.conf.set(name, f"{BATCH_BYTES}b")


def own_columns(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Only the named columns, quoted, so that extra columns never clash."""
    small_batches(df.sparkSession)
    picked = [F.col(f"`{n}`").alias(n) for n in names]
    return df.select(*picked, *[F.col(f"`{c}`").alias(n) for n, c in renamed.items()])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a column: sizes the number of buckets, never the result."""
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0)


# ---- memory of Python workers -----------------------------------------------


def release() -> None:
    """Give freed memory back to the system: a worker lives on, idle, beside those of
    later stages, and what its allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


#: What a worker keeps from task to task (models, encoders).
KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    KEPT.append(cache)
    return cache


def forget() -> None:
    """Drop what tasks of other kinds kept in this worker, which outlives its stage."""
    for cache in KEPT:
        cache.clear()


def lean(step: Callable, keeps: bool = False) -> Callable:
    """A ``mapInArrow`` step that releases memory at the end of each task; one that keeps
    nothing between tasks also gives up what earlier stages kept, at its beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
            release()
        try:
            yield from step(batches)
        finally:
            release()

    return run


def lean_group(step: Callable) -> Callable:
    """An ``applyInArrow`` step that releases memory after each group."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        try:
            return step(table)
        finally:
            release()

    return run


# ---- Arrow columns ---------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as Python objects, one at a time: rows may be wide."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def values(column: pa.Array) -> list:
    """As ``to_pylist``, but whole columns of numbers, texts, bytes and lists at once."""
    if column.null_count or not len(column):
        return column.to_pylist()
    kind = column.type
    if pa.types.is_integer(kind):
        return column.to_numpy().tolist()
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        coded = column.dictionary_encode()
        names = coded.dictionary.to_pylist()
        return [names[i] for i in coded.indices.to_numpy().tolist()]
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        buf, offsets = flat(column)
        items, ends = buf.tobytes(), offsets.tolist()
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        items, ends = values(column.flatten()), [0, *np.cumsum(column.value_lengths().to_numpy()).tolist()]
    else:
        return column.to_pylist()
    return [items[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def packed(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of all ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


# ---- files that tasks write themselves -------------------------------------


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class BlobWriter:
    """Appends blobs to one new file of a shared folder."""

    def __init__(self, folder: str, suffix: str = ".bin", name: str | None = None):
        self.fs, path = open_fs(folder)
        self.fs.create_dir(path, recursive=True)
        self.file = f"{name + '-' if name else ''}{uuid.uuid4().hex}{suffix}"
        self.out = self.fs.open_output_stream(f"{path}/{self.file}", compression=None)
        self.size = 0

    def append(self, blob: bytes) -> int:
        at = self.size
        self.out.write(blob)
        self.size += len(blob)
        return at

    def close(self) -> None:
        self.out.close()


class BlobReader:
    """Byte ranges of the files of a shared folder, with a bounded cache."""

    def __init__(self, folder: str, cache_bytes: int = 32 << 20, decode=lambda b: b):
        self.fs, self.path = open_fs(folder)
        self.files: OrderedDict[str, object] = OrderedDict()
        self.cache: OrderedDict[tuple, bytes] = OrderedDict()
        self.held, self.most, self.decode = 0, cache_bytes, decode

    def _open(self, file: str):
        if file not in self.files:
            self.files[file] = self.fs.open_input_file(f"{self.path}/{file}")
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(file)
        return self.files[file]

    def size(self, file: str) -> int:
        return self._open(file).size()

    def read(self, file: str, offset: int, length: int) -> bytes:
        """Uncached."""
        return self._open(file).read_at(length, offset)

    def get(self, file: str, offset: int, length: int) -> bytes:
        key = (file, offset)
        if key in self.cache:
            self.cache.move_to_end(key)
            return self.cache[key]
        blob = self.decode(self.read(file, offset, length))
        self.cache[key] = blob
        self.held += len(blob)
        while self.held > self.most and len(self.cache) > 1:
            self.held -= len(self.cache.popitem(last=False)[1])
        return blob
