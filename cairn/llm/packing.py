"""Best-fit packing of documents into sequences, planned on the length histogram.

Best-fit decreasing runs on the driver over counts per length - at most one row per
token count up to the sequence length - never over documents.  The plan is a table of
slots: for a run of ranks within a length, the first sequence, how many pieces each
sequence takes and at which offset.  Pieces find their slot by joining on their rank
within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import flat, lean, own_columns, slices, stage
from cairn.llm.wordbpe import default_path, encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Ranks within a length are counted in parts of about so many pieces at most, were all
#: pieces of one length, so that no task ranks a whole length.
RANK_PART = 100_000
#: Slots and pieces meet by length and by rank in steps of this.
RANK_STEP = 4096


def cut(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int | None = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens; only longer documents are cut."""
    path = path or default_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = flat(batch.column("text"))
            for i, j in slices(bounds, 1 << 20):
                part = batch.slice(i, j - i)
                ids, at = with_end(*encoder(path).encode(part.column("text").to_pylist()), end_id)
                data = ids.astype("<u4")
                rows = []
                for doc_id, first, last in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for piece, begin in enumerate(range(first, last, capacity)):
                        end = min(last, begin + capacity)
                        blob = data[begin:end].tobytes()
                        rows.append((doc_id, piece, begin - first, end - begin, zlib.crc32(blob), blob if with_ids else None))
                if rows:
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_pydict({n.split()[0]: pa.array(v, t) for n, v, t in zip(PIECES.split(", "), zip(*rows, strict=True), types, strict=True)})

    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(lean(pieces, keeps=True), PIECES)


def best_fit(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Slots of best-fit decreasing, worked out on counts.

    Columns: length, first and last rank (exclusive), first sequence, pieces in each
    sequence, offset of the first of them.  Sequences that look alike are one group
    (first sequence, number); a length splits at most two groups.
    """
    free: dict[int, list[tuple[int, int]]] = {capacity: []}
    slots, sequences = [], 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        for room in sorted(r for r in free if r >= length):
            groups, each, kept = free[room], room // length, []
            while groups and left:
                first, number = groups.pop()
                full, rest = min(number, left // each), 0
                if full < number and left - full * each:
                    rest = left - full * each
                if full:
                    slots.append((length, rank, rank + full * each, first, each, capacity - room))
                    rank, left = rank + full * each, left - full * each
                    if room - each * length:
                        free.setdefault(room - each * length, []).append((first, full))
                if rest:
                    slots.append((length, rank, rank + rest, first + full, rest, capacity - room))
                    rank, left = rank + rest, 0
                    free.setdefault(room - rest * length, []).append((first + full, 1))
                used = full + bool(rest)
                if used < number:
                    kept.append((first + used, number - used))
            groups += kept
            if not left:
                break
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                slots.append((length, rank, rank + full * each, sequences, each, 0))
                if capacity - each * length:
                    free.setdefault(capacity - each * length, []).append((sequences, full))
            if rest:
                slots.append((length, rank + full * each, rank + left, sequences + full, rest, 0))
                free.setdefault(capacity - rest * length, []).append((sequences + full, 1))
            sequences += full + bool(rest)
        free = {r: g for r, g in free.items() if g}
    return pd.DataFrame(slots, columns=["length", "rank_from", "rank_to", "first_sequence", "each", "first_offset"], dtype="int64")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset.  Every length is 1 to ``capacity``.

    Ties in length are dealt in order of a hash part, id and piece; equal rows are
    packed separately.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]), F.lit(max(1, -(-pieces.count() // RANK_PART)))))
    counts = stage(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    slots = spark.createDataFrame(best_fit(histogram, capacity), "length long, rank_from long, rank_to long, first_sequence long, each long, first_offset long")
    slots = slots.withColumn("step", F.explode(F.sequence(F.expr(f"rank_from div {RANK_STEP}"), F.expr(f"(rank_to - 1) div {RANK_STEP}"))))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")).cast("long") - 1)
    ranked = ranked.join(counts.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("step", F.expr(f"rank div {RANK_STEP}"))
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (ranked["step"] == slots["step"]) & (ranked["rank"] >= slots["rank_from"]) & (ranked["rank"] < slots["rank_to"]))
    turn = F.col("rank") - F.col("rank_from")
    return placed.select(
        *[ranked[c] for c in pieces.columns if c != "part"],
        (F.col("first_sequence") + F.floor(turn / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(turn, F.col("each")) * ranked["length"]).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int | None = 1, with_ids: bool = False) -> DataFrame:
    """Cut and pack whole texts (null: empty).  See ``cut`` and ``pack``."""
    out = pack(stage(cut(docs, capacity, path, end_id, with_ids), "pieces"), capacity)
    return out if with_ids else out.drop("ids")
