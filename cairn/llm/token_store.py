"""A content-addressed store of token ids.

A rolling hash over eight ids cuts each document's ids into chunks wherever the
content says so, so that equal passages give equal chunks.  Every distinct chunk is
stored once, in the pack of the smallest document that has it; packs cover ranges of
ids in ascending order.  A recipe lists a document's chunks, a manifest holds its
Merkle root, and reading verifies chunks and roots.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import BlobReader, BlobWriter, flat, lean, own_columns, shared_dir, slices, stage, text_bytes, values
from cairn.llm.skew import join_once
from cairn.llm.wordbpe import default_path, encoder, with_end

WINDOW, MASK_BITS, LEAST, MOST = 8, 8, 64, 2048
FRAME = 256 << 10
#: A pack file is closed at this size; a shard (a range of ids) may have several.
PACK_BYTES = 64 << 20
#: Ranges of ids are at most so many, as their bounds come to the driver.
MOST_SHARDS = 20_000


def cuts(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of all documents and each document's first chunk.

    A cut may follow a window of eight ids whose hash ends in zeros; chunks hold 64 to
    2,048 ids (the last of a document any number).  Cuts depend on the document alone.
    """
    g = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = g ^ (g >> np.uint64(31))
    step, p = 1, 0xD6E8FEB86659FD93
    while step < WINDOW:
        rolled = h.copy()
        rolled[step:] += h[:-step] * np.uint64(p)
        h, step, p = rolled, step * 2, p * p % (1 << 64)
    marks = np.flatnonzero((h >> np.uint64(64 - MASK_BITS)) == 0) + 1
    low, high = np.searchsorted(marks, at[:-1] + WINDOW), np.searchsorted(marks, at[1:])
    ends, first = [], [0]
    marks = marks.tolist()
    for begin, end, a, b in zip(at[:-1].tolist(), at[1:].tolist(), low.tolist(), high.tolist(), strict=True):
        for cut in (*marks[a:b], end):
            while cut - begin > MOST:
                begin += MOST
                ends.append(begin)
            if cut - begin >= LEAST or cut == end > begin:
                ends.append(cut)
                begin = cut
        first.append(len(ends))
    return np.array(ends, np.int64), np.array(first, np.int64)


def merkle(leaves: list[bytes]) -> bytes:
    """Root over chunk digests; a lone node moves up; none: digest of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=16).digest()
    while len(leaves) > 1:
        leaves = [hashlib.blake2b(b"".join(leaves[i : i + 2]), digest_size=16).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


class _Frames:
    """Gathers blobs into compressed frames of a file; rows wait for their frame."""

    def __init__(self, folder: str, name: str | None = None):
        self.out, self.held, self.size, self.rows = BlobWriter(folder, ".ids", name), [], 0, []
        self.press = zstandard.ZstdCompressor(level=3)

    def add(self, blob: bytes, *row) -> None:
        self.rows.append((*row, self.size))
        self.held.append(blob)
        self.size += len(blob)

    def flush(self) -> list[tuple]:
        """Rows with file, frame offset, frame length and offset inside."""
        if not self.rows:
            return []
        frame = self.press.compress(b"".join(self.held))
        at = self.out.append(frame)
        done = [(*r[:-1], self.out.file, at, len(frame), r[-1]) for r in self.rows]
        self.held, self.size, self.rows = [], 0, []
        return done


def unpress(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


DRAFT = "doc_id long, shard int, n_tokens long, sizes array<int>, digests array<binary>, root binary, file string, frame long, frame_bytes long, at long"
DRAFT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
CHUNKS = "digest binary, uses long, file string, frame long, frame_bytes long, at long"
CHUNK_TYPES = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
ROW = ["doc_id", "file", "frame", "at"]


def _batch(schema: str, types: list, rows: list[tuple]) -> pa.RecordBatch:
    names = []
    for x in schema.split(", "):
        names.append(x.split()[0])
    return pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(names, zip(*rows, strict=True), types, strict=True)})


def write_store(docs: DataFrame, path: str | None = None, end_id: int | None = 1, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode whole texts (null: empty), cut and store them.

    Ids take two bytes, or four if ``wide``.  Rows with equal ids or null ids are
    stored one after another (null first).  An empty table gives an empty store.
    Returns ``recipes``, ``chunks`` (committed tables) and ``folder``.
    """
    spark, path, width = docs.sparkSession, path or default_path(), np.dtype("<u4" if wide else "<u2")
    docs = own_columns(docs, doc_id=id_col, text=text_col)
    shards = min(MOST_SHARDS, max(text_bytes(docs, "text") // PACK_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)] or [1.0], 10_000)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))
    drafts = shared_dir(spark, "id-drafts")

    def draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = None
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for i, j in slices(offsets, 4 << 20):
                frames = frames or _Frames(drafts)
                part = batch.slice(i, j - i)
                ids, at = with_end(*encoder(path).encode(part.column("text").to_pylist()), end_id)
                if len(ids) and int(ids.max()) >= 1 << (8 * width.itemsize):
                    raise ValueError("ids need four bytes: pass wide=True")
                data, (ends, first) = ids.astype(width).tobytes(), cuts(ids, at)
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip((begins * width.itemsize).tolist(), (ends * width.itemsize).tolist(), strict=True)]
                sizes, rows = (ends - begins).tolist(), []
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = slice(first[k], first[k + 1])
                    shard = 0 if doc_id is None else int(np.searchsorted(bounds, doc_id, "right"))
                    frames.add(data[at[k] * width.itemsize : at[k + 1] * width.itemsize], doc_id, shard, int(at[k + 1] - at[k]), sizes[own], digests[own], merkle(digests[own]))
                    if frames.size >= FRAME:
                        rows += frames.flush()
                rows += frames.flush()
                yield _batch(DRAFT, DRAFT_TYPES, rows)
        if frames:
            frames.out.close()

    recipes = stage(docs.mapInArrow(lean(draft, keeps=True), DRAFT), "recipes")
    chunk = recipes.select(*ROW, "shard", F.posexplode("digests").alias("pos", "digest"))
    owners = chunk.groupBy("digest").agg(F.min(F.struct(*ROW, "shard", "pos")).alias("o"), F.count(F.lit(1)).alias("uses")).groupBy("o.shard", *[f"o.{c}" for c in ROW]).agg(F.sort_array(F.collect_list(F.struct("o.pos", "uses"))).alias("own"))
    folder = shared_dir(spark, "id-store")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames, reader = None, BlobReader(drafts, 48 << 20, unpress)
        for batch in batches:
            rows = []
            for shard, file, frame, frame_bytes, at, sizes, digests, places, uses in zip(*map(values, batch.columns), strict=True):
                if frames and frames.out.size >= PACK_BYTES:
                    rows += frames.flush()
                    frames.out.close()
                    frames = None
                frames = frames or _Frames(folder, f"pack-{shard:06d}")
                data = reader.get(file, frame, frame_bytes)
                ends = list(accumulate((n * width.itemsize for n in sizes), initial=at))
                for pos, n in zip(places, uses, strict=True):
                    frames.add(data[ends[pos] : ends[pos + 1]], digests[pos], n)
                    if frames.size >= FRAME:
                        rows += frames.flush()
            if rows:
                yield _batch(CHUNKS, CHUNK_TYPES, rows)
        if frames and (rows := frames.flush()):
            yield _batch(CHUNKS, CHUNK_TYPES, rows)
        if frames:
            frames.out.close()

    same = [recipes["shard"] == owners["shard"], recipes["doc_id"].eqNullSafe(owners["doc_id"]), *[recipes[c] == owners[c] for c in ROW[1:]]]
    owned = recipes.drop("root", "n_tokens").join(owners, same, "inner").select(*[recipes[c] for c in (*ROW, "shard", "frame_bytes", "sizes", "digests")], "own")
    owned = owned.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "file", "frame", "at")
    owned = owned.select("shard", "file", "frame", "frame_bytes", "at", "sizes", "digests", F.col("own.pos").alias("places"), F.col("own.uses").alias("uses"))
    return {"recipes": recipes, "chunks": stage(owned.mapInArrow(lean(store), CHUNKS), "chunks"), "folder": folder, "shards": shards, "width": width}


def read_store(store: dict) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the packs, in which every chunk and
    every document's Merkle root is verified (a mismatch raises)."""
    recipes, chunks, folder, shards, width = (store[k] for k in ("recipes", "chunks", "folder", "shards", "width"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, doc_id, leaves, crc, n, root, start, shard, rows = BlobReader(folder, 64 << 20, unpress), None, [], 0, 0, None, 0, None, []
        blobs, held = [], 0

        def summed():
            nonlocal crc, held
            crc = zlib.crc32(np.frombuffer(b"".join(blobs), width).astype("<u4"), crc)
            blobs.clear()
            held = 0

        def done():
            summed()
            if merkle(leaves) != root:
                raise ValueError(f"document {doc_id} doesn't have its Merkle root")
            rows.append((doc_id, shard, start, n, crc))

        for batch in batches:
            for own_id, own_shard, own_root, pos, size, digest, file, frame, frame_bytes, at in zip(*map(values, batch.columns), strict=True):
                if not pos:  # a document's first chunk, or the row of one that has none
                    if root is not None:
                        done()
                        start += n
                    if own_shard != shard:
                        start, shard = 0, own_shard
                    doc_id, leaves, crc, n, root = own_id, [], 0, 0, own_root
                if digest is None:
                    continue
                blob = reader.get(file, frame, frame_bytes)[at : at + size * width.itemsize]
                if hashlib.blake2b(blob, digest_size=16).digest() != digest:
                    raise ValueError(f"damaged chunk in {file}")
                leaves.append(digest)
                blobs.append(blob)
                held += len(blob)
                if held >= FRAME:
                    summed()
                n += size
            if rows:
                yield _batch(READ, READ_TYPES, rows)
                rows.clear()
        if root is not None:
            done()
            yield _batch(READ, READ_TYPES, rows)

    rows = recipes.select("doc_id", "shard", "root", F.col("file").alias("doc_file"), F.col("frame").alias("doc_frame"), F.col("at").alias("doc_at"), F.posexplode_outer(F.arrays_zip("sizes", "digests")).alias("pos", "x"))
    rows = rows.select("*", F.col("x.sizes").alias("size"), F.col("x.digests").alias("digest")).drop("x")
    # a chunk that many documents share (an empty text's, a licence's) doesn't fill one task
    uses = recipes.agg(F.sum(F.size("digests"))).first()[0] or 0
    rows = join_once(rows, chunks, "digest", "uses", uses, ["doc_file", "doc_frame", "doc_at", "pos"]).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "doc_file", "doc_frame", "doc_at", "pos")
    rows = rows.select("doc_id", "shard", "root", "pos", "size", "digest", "file", "frame", "frame_bytes", "at")
    totals = recipes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per pack
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = rows.mapInArrow(lean(read), READ).join(F.broadcast(totals), "shard")
    return out.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


READ = "doc_id long, shard int, local long, n_tokens long, ids_crc32 long"
READ_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
