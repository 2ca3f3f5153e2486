"""Token counts of flat, unindexed token files.

A file is ids in a row, each document closed by an end-of-document id; nothing says
where documents begin.  Blocks of a file are scanned apart for that id, and a prefix
scan over the blocks' summaries - separators so far, place of the last one - joins the
documents that block boundaries cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import BlobReader, BlobWriter, flat, lean, own_columns, shared_dir, slices, stage
from cairn.llm.wordbpe import default_path, encoder, with_end

#: Past the vocabulary of 49,408, so no text can hold it.
END_OF_DOCUMENT = 49_408
BLOCK_BYTES = 8 << 20
ORDER = "file string, ordinal long, doc_id long"


def write_flat(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_OF_DOCUMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write whole texts (null: empty) as flat files of two-byte ids.

    Returns, committed, which document each file holds at which place; the files
    themselves hold ids and nothing else.
    """
    path = path or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ordinal = None, 0
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for i, j in slices(offsets, 4 << 20):
                out = out or BlobWriter(folder, ".tokens")
                part = batch.slice(i, j - i)
                ids, at = encoder(path).encode(part.column("text").to_pylist())
                if len(ids) and (int(ids.max()) >= 1 << 16 or bool((ids == end_id).any())):
                    raise ValueError("ids must fit two bytes and differ from the end-of-document id")
                out.append(with_end(ids, at, end_id)[0].astype("<u2").tobytes())
                yield pa.RecordBatch.from_pydict({"file": pa.array([out.file] * (j - i)), "ordinal": pa.array(np.arange(ordinal, ordinal + j - i)), "doc_id": part.column("doc_id").cast(pa.int64())})
                ordinal += j - i
        if out:
            out.close()

    return stage(own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(lean(write, keeps=True), ORDER), "flat-order")


def scan(spark: SparkSession, folder: str, files: DataFrame, end_id: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start, n_tokens (with the end id) of every document of ``files``
    (file, size).  What follows a file's last separator is a document too, without an
    end id.  An empty file has no documents.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BlobReader(folder)
        for batch in batches:
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                ids = np.frombuffer(reader.read(file, at, min(block_bytes, size - at)), "<u2")
                found = np.flatnonzero(ids == end_id) + at // 2
                yield pa.RecordBatch.from_pydict({"file": pa.array([file]), "at": pa.array([at]), "stop": pa.array([at // 2 + len(ids)]), "total": pa.array([size // 2]), "found": pa.array([found.tolist()], pa.list_(pa.int64()))})

    blocks = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))).alias("at"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = stage(blocks.repartition(parts, "file", "at").mapInArrow(lean(search), "file string, at long, stop long, total long, found array<long>"), "separators")
    # the prefix scan over a file's blocks, of which a row holds only counts and places
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "at", F.size("found").alias("n"), F.element_at(F.when(F.size("found") > 0, F.col("found")), -1).alias("last"))
    summary = summary.select("file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    joined = found.join(summary, ["file", "at"])
    tail = F.when(F.col("stop") == F.col("total"), F.col("total") - 1)
    ends = F.when((F.coalesce(F.element_at(F.when(F.size("found") > 0, F.col("found")), -1), F.col("previous")) < tail), F.concat("found", F.array(tail))).otherwise(F.col("found"))
    joined = joined.withColumn("ends", ends).withColumn("begins", F.concat(F.array(F.col("previous") + 1), F.transform("found", lambda x: x + 1)))
    each = joined.select("file", "ordinal", "begins", F.posexplode("ends").alias("pos", "last"))
    start = F.element_at("begins", F.col("pos") + 1)
    return each.select("file", (F.col("ordinal") + F.col("pos")).alias("ordinal"), start.alias("start"), (F.col("last") + 1 - start).alias("n_tokens"))


def sizes(folder: str, names: DataFrame) -> DataFrame:
    """file and its size, looked up on the executors."""

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BlobReader(folder)
        for batch in batches:
            files = batch.column("file").to_pylist()
            yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.string()), "size": pa.array([reader.size(f) for f in files], pa.int64())})

    return names.mapInArrow(stat, "file string, size long")


def count_tokens(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens (with the end id) and start in its file, found by scanning the
    flat files.  One row per row: null text counts as empty, which is an end id alone;
    null and repeated ids are rows like others.  An empty table gives an empty result;
    other columns are ignored."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "flat")
    order = write_flat(docs, folder, path)
    files = sizes(folder, order.select("file").distinct())
    return order.join(scan(spark, folder, files, block_bytes=block_bytes), ["file", "ordinal"]).select("doc_id", "n_tokens", "start")
