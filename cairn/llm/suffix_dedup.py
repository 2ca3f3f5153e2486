"""Removal of repeated byte windows: depth-limited radix sorting of suffixes.

A byte is removed if a window of ``threshold`` bytes covers it that also starts in a
document with a smaller id.  Suffixes are ordered only through ``threshold`` bytes,
most significant digit first; suffixes still equal after the last digit are exactly
the repeated windows.

The first digit of a window stands for the smallest hash of the short byte strings in
it, so equal windows have the same first digit and neighbouring windows mostly share one.
Runs of windows with one first digit are dealt to buckets by it in two steps: first the
digits alone (four bytes each), to learn which occur in more than one place, then the
text under those.  A digit of very many runs (the edges of a passage that many documents
share) would fill one bucket; its windows are dealt singly, by a second digit of all
their bytes, again digits first, after which only windows that do repeat are left.
Within a bucket the windows are refined eight bytes at a time, and a group goes on only
while it has more than one member.  Text stays in compressed blocks in the shared
folder; only digits, runs and bit masks are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BlobReader, BlobWriter, Shelf, each_row, flat, lean, lean_group, own_columns, shared_dir, slices, spread, stage, text_bytes
from cairn.llm.skew import join_groups
from cairn.llm.wordbpe import distinct_spans

BLOCK = 2 << 20
BUCKET_BYTES = 8 << 20
#: Windows whose digits are computed at once, whatever the size of a document.
CHUNK = 1 << 20
#: Windows of a bucket that are compared, or marked, at once.
PORTION = 1 << 19
RUN = 64
#: A first digit of more runs than this is dealt on by a second one.
HOT_RUNS = 20_000
NO_ID = (1 << 63) - 1


def _pack(folder: str, out: BlobWriter | None, blob: bytes) -> tuple[BlobWriter, str]:
    """Appends a compressed blob; its place as text."""
    out = out or BlobWriter(folder, ".blk")
    blob = zstandard.ZstdCompressor(level=1).compress(blob)
    return out, f"{out.file}:{out.append(blob)}:{len(blob)}"


def _unpack(reader: BlobReader, place: str) -> bytes:
    file, at, size = place.split(":")
    return zstandard.ZstdDecompressor().decompress(reader.read(file, int(at), int(size)))


# ---- digits and runs -------------------------------------------------------


def digit_size(threshold: int) -> int:
    return max(8, min(24, 2 * threshold // 5))


def load8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian numbers."""
    padded = np.concatenate([buf, np.zeros(7, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(buf), 8), (1, 1)).copy().view("<u8")[:, 0]


def first_digits(buf: np.ndarray, threshold: int) -> np.ndarray:
    """For each window start the smallest hash of the k-byte strings inside."""
    k = digit_size(threshold)
    n, span = len(buf) - k + 1, threshold - k + 1
    eight, mix = load8(buf), np.uint64(0x9E3779B97F4A7C15)
    h = eight[:n] * mix
    h ^= h >> np.uint64(29)
    for at in [*range(8, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h += eight[at : at + n]
        h *= mix
        h ^= h >> np.uint64(31)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        h = np.minimum(h[: len(h) - step], h[step:])
        reach += step
    return h


def even(digit: np.ndarray) -> np.ndarray:
    """One to one; minima are mostly small and would fill the first buckets only."""
    digit = (digit ^ (digit >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return digit ^ (digit >> np.uint64(32))


def runs(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, threshold: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First digit, first window and number of windows of each run in the given
    documents; at most RUN windows to a run, none across documents.  The text is gone
    through in chunks that overlap by a window, so long documents take no more memory."""
    found = []
    for low in range(0, len(buf) - threshold + 1, chunk):
        high = min(len(buf), low + chunk + threshold - 1)
        begin, end = np.maximum(begins, low) - low, np.minimum(ends, high) - low
        inside = end - begin >= threshold
        if inside.any():
            digit, start, number = _chunk_runs(buf[low:high], begin[inside], end[inside], threshold)
            found.append((digit, start + low, number))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _chunk_runs(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    digit = first_digits(buf, threshold)
    change = np.zeros(len(digit) + 1, np.int8)
    change[begins] += 1
    change[ends - threshold + 1] -= 1
    valid = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    head = valid.copy()
    head[1:] &= digit[1:] != digit[:-1]
    head[begins] = True
    starts = np.flatnonzero(head)
    stops = np.append(starts[1:], len(digit))
    last = ends[np.searchsorted(begins, starts, "right") - 1] - threshold + 1
    number = np.minimum(stops, last) - starts
    pieces = -(-number // RUN)
    if pieces.max() > 1:
        turn = spread(np.zeros(len(pieces), np.int64), pieces)
        starts, number = np.repeat(starts, pieces) + turn * RUN, np.repeat(number, pieces) - turn * RUN
        number = np.minimum(number, RUN)
    return even(digit[starts]), starts, number


def second_digits(buf: np.ndarray, starts: np.ndarray, threshold: int) -> np.ndarray:
    """A hash of all bytes of each window."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    h, mix = np.full(len(starts), threshold, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for at in [*range(0, threshold - 7, 8), *([threshold - 8] if threshold % 8 else [])]:
        h += words[starts + at].copy().view("<u8")[:, 0]
        h *= mix
        h ^= h >> np.uint64(31)
    return even(h)


def _bounds(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and ids of the documents of a block."""
    ends = np.cumsum(np.array(row["sizes"], np.int64))
    return ends - np.array(row["sizes"], np.int64), ends, np.array(row["doc_ids"], np.int64)


def _runs_of(row: dict, buf: np.ndarray, threshold: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begins, ends, _ = _bounds(row)
    own = np.ones(len(begins), bool)
    own[row["copies"] or []] = False
    return runs(buf, begins[own], ends[own], threshold, chunk)


def _digit_rows(block: str, digit: np.ndarray, bits: int) -> pa.RecordBatch:
    """bucket, block and message of a block's digits: 32 bits of each distinct one, and
    how often those come that come more than once."""
    digit, times = np.unique(digit, return_counts=True)
    at = _by_bucket(digit, bits)
    tail = ((digit << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
    some, blobs = np.flatnonzero(np.diff(at)), []
    for b in some:
        own = times[at[b] : at[b + 1]]
        more = np.flatnonzero(own > 1)
        blobs.append(b"".join([np.array([len(own)], "<u4").tobytes(), tail[at[b] : at[b + 1]].tobytes(), more.astype("<u4").tobytes(), own[more].astype("<u4").tobytes()]))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "block": pa.array([block] * len(some), pa.string()), "digits": pa.array(blobs, pa.binary())})


DIGITS = "bucket int, block string, digits binary"
REPLIES = "bucket int, block string, bits binary, hot boolean"


def several_places(table: pa.Table, hot_runs: int) -> pa.Table:
    """For each message of a bucket a bit for every digit: whether it occurs in several
    places; then one more for each: whether it is hot."""
    parts, times = [], []
    for blob in table.column("digits").to_pylist():
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        parts.append(np.frombuffer(blob, "<u4", n, 4))
        times.append(np.ones(n, np.int64))
        more = np.frombuffer(blob, "<u4", -1, 4 + 4 * n).reshape(2, -1)
        times[-1][more[0]] = more[1]
    values = np.concatenate(parts)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    twice, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
    twice[order] = (np.diff(np.append(heads, len(values))) > 1)[group]
    hot[order] = (np.add.reduceat(np.concatenate(times)[order], heads) > hot_runs)[group]
    ends = np.cumsum([len(p) for p in parts])
    places = [slice(e - len(p), e) for p, e in zip(parts, ends, strict=True)]
    bitsets = [np.packbits(np.concatenate([twice[x], hot[x]])).tobytes() for x in places]
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "bits": pa.array(bitsets, pa.binary()), "hot": pa.array([bool(hot[x].any()) for x in places], pa.bool_())})


def _answers(digit: np.ndarray, replies: list[dict], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of a block's digits whether it is in several places, and hot."""
    values, which = np.unique(digit, return_inverse=True)
    at = _by_bucket(values, bits)
    shared, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
    for reply in replies or []:
        a, b = at[reply["bucket"]], at[reply["bucket"] + 1]
        both = np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=2 * (b - a)).astype(bool)
        shared[a:b], hot[a:b] = both[: b - a], both[b - a :]
    return shared[which], hot[which]


def _owners_differ(digit: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a digit comes under several owners."""
    values, which = np.unique(digit, return_inverse=True)
    low, high = np.full(len(values), NO_ID), np.full(len(values), -NO_ID)
    np.minimum.at(low, which, owner)
    np.maximum.at(high, which, owner)
    return (low != high)[which]


def _by_bucket(digits: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's part of sorted digits begins and ends."""
    return np.searchsorted(digits >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(digits)])


# ---- equal windows within a bucket -----------------------------------------


def equal_groups(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the windows at ``starts``, which ``group``
    divides already.  Returns the windows that have an equal one, ordered so that
    equal windows are neighbours, and where their groups begin."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    alive = np.arange(len(starts))
    for at in [*range(0, threshold - 7, 8), *([threshold - 8] if threshold % 8 else [])]:
        digit = words[starts[alive] + at].copy().view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((digit, group))
        digit, group, alive = digit[order], group[order], alive[order]
        new = np.ones(len(alive) + 1, bool)
        new[1:-1] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        keep = ~(new[:-1] & new[1:])
        group = np.cumsum(new[:-1])[keep]
        alive = alive[keep]
        if not len(alive):
            break
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(alive) else np.zeros(0, np.int64)
    return alive, heads


def repeated(texts: list[bytes], digits: np.ndarray, owner: np.ndarray, threshold: int, portion: int = PORTION) -> np.ndarray:
    """A bit mask for each run of a bucket: its windows that also stand under a smaller
    owner.  owner: the smallest document id with that run in the block it is from.
    Digits are gone through in portions of windows, so that only the texts and one number
    per window are held for the whole bucket."""
    index: dict[bytes, int] = {}
    which = np.fromiter((index.setdefault(t, len(index)) for t in texts), np.int64, len(texts))
    distinct = list(index)
    smallest = np.full(len(distinct), NO_ID)
    np.minimum.at(smallest, which, owner)
    digit = np.zeros(len(distinct), np.uint64)
    digit[which] = digits
    sizes = np.array([len(t) for t in distinct], np.int64)
    number = sizes - threshold + 1
    offsets = np.cumsum(sizes) - sizes
    window_of = np.cumsum(number) - number
    least = np.repeat(smallest, number)
    _, group, members = np.unique(digit, return_inverse=True, return_counts=True)
    several = np.flatnonzero(members[group] > 1)
    if len(several):
        buf = np.frombuffer(b"".join(distinct), np.uint8)
        several = several[np.argsort(group[several], kind="stable")]
        heads = np.append(np.flatnonzero(np.append(True, np.diff(group[several]) != 0)), len(several))
        total = np.append(0, np.cumsum(number[several]))
        for i, j in slices(total[heads], portion):
            own = several[heads[i] : heads[j]]
            windows, starts = spread(window_of[own], number[own]), spread(offsets[own], number[own])
            alive, begin = equal_groups(buf, starts, np.repeat(group[own], number[own]), threshold)
            if len(alive):
                low = np.minimum.reduceat(least[windows[alive]], begin)
                least[windows[alive]] = np.repeat(low, np.diff(np.append(begin, len(alive))))
    each, masks = number[which], np.zeros(len(which), np.uint64)
    for i, j in slices(np.append(0, np.cumsum(each)), portion):
        own = each[i:j]
        hit = least[spread(window_of[which[i:j]], own)] < np.repeat(owner[i:j], own)
        bit = spread(np.zeros(len(own), np.int64), own).astype(np.uint64)
        masks[i:j] = np.bitwise_or.reduceat(hit.astype(np.uint64) << bit, np.cumsum(own) - own)
    return masks


# ---- the distributed steps -------------------------------------------------

BLOCKS = "block string, doc_ids array<long>, sizes array<long>, digests array<binary>"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _blocks(docs: DataFrame, folder: str, shelf: Shelf) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ids, texts, held = None, [], [], 0

        def done():
            nonlocal out, ids, texts, held
            out, place = _pack(folder, out, b"".join(texts))
            row = {"block": [place], "doc_ids": [ids], "sizes": [[len(t) for t in texts]], "digests": [[hashlib.blake2b(t, digest_size=16).digest() for t in texts]]}
            ids, texts, held = [], [], 0
            return pa.RecordBatch.from_pydict({"block": pa.array(row["block"]), "doc_ids": pa.array(row["doc_ids"], pa.list_(pa.int64())), "sizes": pa.array(row["sizes"], pa.list_(pa.int64())), "digests": pa.array(row["digests"], pa.list_(pa.binary()))})

        for batch in batches:
            buf, at = flat(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids.append(doc_id)
                texts.append(buf[a:b].tobytes())
                held += b - a
                if held >= BLOCK:
                    yield done()
        if ids:
            yield done()
        if out is not None:
            out.close()

    return shelf.stage(docs.mapInArrow(lean(write), BLOCKS), "blocks")


def _copies(blocks: DataFrame, shelf: Shelf) -> DataFrame:
    """block, and the places in it of documents whose whole text a smaller id has."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "digests")).alias("place", "d")).select("block", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.digests").alias("digest"))
    groups = shelf.stage(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    found = join_groups(rows, groups, "digest", "n", rows.count()).where("doc_id > least")
    return found.groupBy("block").agg(F.collect_list("place").alias("copies"))


def remove_repeats(docs: DataFrame, threshold: int = 50, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, and with ``with_text`` also ``kept``: the text without what was removed,
    in which a character goes only if all its bytes do, and text_sha256 of the input.

    Windows are judged on the input and never cross documents; rows that share an id
    don't count against each other.  Null text is empty; a null id counts as the largest.
    An empty table gives an empty result; other columns are ignored.
    """
    if threshold < 16:
        raise ValueError("threshold must be 16 bytes at least")
    spark = docs.sparkSession
    docs = own_columns(docs, doc_id=id_col, text=text_col).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    bits = max(4, int(np.ceil(np.log2(max(1, text_bytes(docs, "text") / BUCKET_BYTES)))))
    folder, chunk, hot_runs = shared_dir(spark, "suffix"), CHUNK, HOT_RUNS
    shelf = Shelf(spark)
    blocks = _blocks(docs, folder, shelf)
    tasks = max(1, min(blocks.count(), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = shelf.stage(blocks.join(_copies(blocks, shelf), "block", "left").drop("digests"), "marked")

    def digits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BlobReader(folder)
        for batch in batches:
            for row in each_row(batch):
                digit, _, _ = _runs_of(row, np.frombuffer(_unpack(reader, row["block"]), np.uint8), threshold, chunk)
                yield _digit_rows(row["block"], digit, bits)

    def hot_digits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BlobReader(folder)
        for batch in batches:
            for row in each_row(batch):
                buf = np.frombuffer(_unpack(reader, row["block"]), np.uint8)
                digit, starts, number = _runs_of(row, buf, threshold, chunk)
                hot = _answers(digit, row["replies"], bits)[1]
                yield _digit_rows(row["block"], second_digits(buf, spread(starts[hot], number[hot]), threshold), bits)

    def asked(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket").applyInArrow(lean_group(lambda table: several_places(table, hot_runs)), REPLIES)

    replies = asked(blocks.repartition(tasks).mapInArrow(lean(digits_of), DIGITS))
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"), F.max("hot").alias("hot"))
    replied = shelf.stage(blocks.join(replies, "block"), "replies")
    second = asked(replied.where("hot").repartition(tasks).mapInArrow(lean(hot_digits_of), DIGITS))
    second = shelf.stage(second.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("seconds")), "second-replies")
    shelf.sweep()
    replied = replied.join(second, "block", "left")

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = BlobReader(folder), None
        for batch in batches:
            for row in each_row(batch):
                data = _unpack(reader, row["block"])
                buf = np.frombuffer(data, np.uint8)
                begins, _, ids = _bounds(row)
                digit, starts, number = _runs_of(row, buf, threshold, chunk)
                owner = ids[np.searchsorted(begins, starts, "right") - 1]
                shared, hot = _answers(digit, row["replies"], bits)
                pick = np.flatnonzero((shared | _owners_differ(digit, owner)) & ~hot)
                singly = spread(starts[hot], number[hot])
                digit2, owner2 = second_digits(buf, singly, threshold), np.repeat(owner[hot], number[hot])
                pick2 = np.flatnonzero(_answers(digit2, row["seconds"], bits)[0] | _owners_differ(digit2, owner2))
                starts, number, owner, digit = (np.concatenate([x[pick], y[pick2]]) for x, y in ((starts, singly), (number, np.ones(len(singly), np.int64)), (owner, owner2), (digit, digit2)))
                if not len(starts):
                    continue
                order = np.argsort(digit, kind="stable")
                starts, number, owner, digit = starts[order], number[order], owner[order], digit[order]
                run, heads = distinct_spans(buf, starts, number + (threshold - 1))
                order = np.argsort(heads, kind="stable")  # in the order of digits again
                heads, place_of = heads[order], np.empty(len(order), np.int64)
                place_of[order] = np.arange(len(order))
                run = place_of[run]
                least = np.full(len(heads), NO_ID)
                np.minimum.at(least, run, owner)
                run_digit, sizes = digit[heads], (number[heads] + (threshold - 1)).astype("<u4")
                later = owner > least[run]
                note = [np.array([len(run)], "<i8"), starts.astype("<i8"), run.astype("<i8"), number.astype("u1"), later.astype("u1")]
                out, place = _pack(folder, out, b"".join(x.tobytes() for x in note))
                at = _by_bucket(run_digit, bits)
                first, some, blobs = starts[heads].tolist(), np.flatnonzero(np.diff(at)), []
                for b in some:
                    own = slice(at[b], at[b + 1])
                    texts = [data[x : x + n] for x, n in zip(first[own], sizes[own].tolist(), strict=True)]
                    blobs.append(b"".join([np.array([len(texts)], "<i8").tobytes(), run_digit[own].tobytes(), least[own].tobytes(), sizes[own].tobytes(), *texts]))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "block": pa.array([row["block"]] * len(some), pa.string()), "place": pa.array([place] * len(some), pa.string()), "runs": pa.array(blobs, pa.binary())})
        if out is not None:
            out.close()

    def compare(table: pa.Table) -> pa.Table:
        digit, owner, texts, counts = [], [], [], []
        for blob in table.column("runs").to_pylist():
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            digit.append(np.frombuffer(blob, "<u8", n, 8))
            owner.append(np.frombuffer(blob, "<i8", n, 8 + 8 * n))
            ends = (np.cumsum(np.frombuffer(blob, "<u4", n, 8 + 16 * n), dtype=np.int64) + 8 + 20 * n).tolist()
            texts += [blob[a:b] for a, b in zip([8 + 20 * n, *ends[:-1]], ends, strict=True)]
            counts.append(n)
        masks = repeated(texts, np.concatenate(digit), np.concatenate(owner), threshold).astype("<u8")
        ends = np.cumsum(counts)
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "place": table.column("place"), "masks": pa.array([masks[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())})

    masks = replied.repartition(tasks).mapInArrow(lean(runs_of), "bucket int, block string, place string, runs binary")
    masks = masks.groupBy("bucket").applyInArrow(lean_group(compare), "bucket int, block string, place string, masks binary")
    masks = masks.groupBy("block").agg(F.first("place").alias("place"), F.sort_array(F.collect_list(F.struct("bucket", "masks"))).alias("masks"))
    answered = stage(blocks.join(masks, "block", "left"), "masks")
    shelf.clear()

    def removed(row: dict, reader: BlobReader, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends, in order, of what goes: windows found to repeat, and copies."""
        first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if row["place"]:
            note = _unpack(reader, row["place"])
            n = int(np.frombuffer(note, "<i8", 1)[0])
            starts, run = np.frombuffer(note, "<i8", n, 8), np.frombuffer(note, "<i8", n, 8 + 8 * n)
            number, later = np.frombuffer(note, "u1", n, 8 + 16 * n).astype(np.int64), np.frombuffer(note, "u1", n, 8 + 17 * n)
            whole = ~np.uint64(0) >> (RUN - number).astype(np.uint64)
            mask = np.frombuffer(b"".join(x["masks"] for x in row["masks"]), "<u8")[run]
            mask = np.where(later == 1, whole, mask)
            full, some = mask == whole, np.flatnonzero((mask != whole) & (mask != 0))
            turn = spread(np.zeros(len(some), np.int64), number[some])
            hit = (np.repeat(mask[some], number[some]) >> turn.astype(np.uint64)) & np.uint64(1) == 1
            windows = (np.repeat(starts[some], number[some]) + turn)[hit]
            first += [starts[full], windows]
            last += [starts[full] + number[full] + (threshold - 1), windows + threshold]
        copies = np.array(row["copies"] or [], np.int64)
        copies = copies[(ends - begins)[copies] >= threshold]
        first, last = np.concatenate([*first, begins[copies]]), np.concatenate([*last, ends[copies]])
        order = np.argsort(first, kind="stable")
        return first[order], last[order]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BlobReader(folder)
        for batch in batches:
            for row in each_row(batch):
                data = _unpack(reader, row["block"])
                begins, ends, ids = _bounds(row)
                first, last = removed(row, reader, begins, ends)
                if len(first):  # maximal runs, none across documents
                    last = np.maximum.accumulate(last)
                    of = np.searchsorted(ends, first, "right")
                    new = np.append(True, (first[1:] > last[:-1]) | (of[1:] != of[:-1]))
                    last = last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]
                    first = first[new]
                if with_text and len(first):  # whole characters only
                    buf = np.frombuffer(data + b"\0", np.uint8)
                    for _ in range(3):
                        first = first + ((buf[first] & 0xC0) == 0x80)
                        last = last - ((buf[last] & 0xC0) == 0x80)
                    first, last = first[first < last], last[first < last]
                of = np.searchsorted(ends, first, "right")
                n_removed = np.bincount(of, last - first, len(ids)).astype(np.int64)
                n_spans, turn = np.bincount(of, minlength=len(ids)), 0
                text, hashes, kept = memoryview(data), [], []
                for begin, end, n in zip(begins.tolist(), ends.tolist(), n_spans.tolist(), strict=True):
                    sha, parts = hashlib.sha256(), []
                    for a, b in zip([begin, *last[turn : turn + n].tolist()], [*first[turn : turn + n].tolist(), end], strict=True):
                        sha.update(text[a:b])
                        if with_text:
                            parts.append(text[a:b])
                    turn += n
                    hashes.append(sha.hexdigest())
                    if with_text:
                        kept.append(b"".join(parts).decode())
                columns = {
                    "doc_id": pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()),
                    "n_bytes": pa.array(ends - begins),
                    "n_removed": pa.array(n_removed),
                    "n_spans": pa.array(n_spans),
                    "kept_sha256": pa.array(hashes, pa.string()),
                }
                if with_text:
                    columns |= {"kept": pa.array(kept, pa.string()), "text_sha256": pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return answered.repartition(tasks).mapInArrow(lean(cut), RESULT + (", kept string, text_sha256 string" if with_text else ""))
