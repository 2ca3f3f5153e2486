"""Jaccard similarity join on word shingles with parity sketches.

A document's set is its distinct shingles, each known by 128 bits that come from keyed
hashes of its words.  For each band of set sizes the hash range is cut
into parts, more of them than two linked sets of the band can differ in, and each part
is sketched by XOR: a word of one-bit parities (whose Hamming distance never exceeds the
symmetric difference) and the XOR of the hashes themselves.  Each differing shingle
spoils one part at most, so linked sets agree in a part (pigeonhole) and meet under its
key.  Sets that meet are verified on 96 of the bits; equal sets are one class throughout.
In each group of classes that share a key a star is verified first: all members against
the one that shares most keys.  Groups that are then not yet connected are compared in
blocks of members, where bit sketches and the triangle inequality leave out nearly all
that isn't linked; what is shuffled for it are places of blocks, and only links leave a
task, so no list of pairs of members is ever made and no link that would join two
components is lost.
"""

from __future__ import annotations

import hashlib
import math
import os
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BlobReader, BlobWriter, Shelf, flat, lean, lean_group, own_columns, slices, stage, text_bytes
from cairn.llm.skew import join_groups

BUCKET_BYTES = 8 << 20
BAND_GROWTH = 1.25
#: Odds that a set has so many empty parts that their keys are needed too.
EMPTY_ODDS = 1e-7
BITMAP_LOW, BITMAP_HIGH = 16, 28
#: Edges that one task contracts before rounds over all of them.
EDGES_PER_TASK = 500_000
#: Members of a group are compared in blocks of about this many.
MEMBERS = 48

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def _rotated(x: np.ndarray, bits: int) -> None:
    low = x >> np.uint64(64 - bits)
    x <<= np.uint64(bits)
    x |= low


def _sip_rounds(v: list[np.ndarray], rounds: int) -> None:
    a, b, c, d = v
    for _ in range(rounds):
        a += b
        c += d
        _rotated(b, 13)
        _rotated(d, 16)
        b ^= a
        d ^= c
        _rotated(a, 32)
        c += b
        a += d
        _rotated(b, 17)
        _rotated(d, 21)
        b ^= c
        d ^= a
        _rotated(c, 32)


def word_lanes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: bytes) -> np.ndarray:
    """128-bit SipHash-2-4 of each word, in two rows; of words past 256 bytes a keyed
    BLAKE2b.  The key is secret and new in each run, so no words can be made to collide."""
    out = np.empty((2, len(starts)), np.uint64)
    k0, k1 = np.frombuffer(key, "<u8")
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    short = np.flatnonzero(lengths <= 256)
    for i in range(0, len(short), 1 << 15):  # so that the states stay in the cache
        own = short[i : i + (1 << 15)]
        own = own[np.argsort(-(lengths[own] >> 3), kind="stable")]  # who is still at work comes first
        size, begin = lengths[own], starts[own]
        v = [np.full(len(own), x, np.uint64) for x in (k0 ^ np.uint64(0x736F6D6570736575), k1 ^ np.uint64(0x646F72616E646F6D ^ 0xEE), k0 ^ np.uint64(0x6C7967656E657261), k1 ^ np.uint64(0x7465646279746573))]
        for at in range(0, int(size[0] >> 3) * 8 + 8, 8):
            live = int(np.searchsorted(-(size >> 3), -(at >> 3), "right"))
            left = size[:live] - at
            chunk = words[begin[:live] + at].copy().view("<u8")[:, 0]
            last = left < 8
            drop = np.where(last, 8 - left, 0).astype(np.uint64) * np.uint64(8)
            chunk = np.where(drop == 64, np.uint64(0), (chunk << (drop & np.uint64(63))) >> (drop & np.uint64(63)))
            chunk |= np.where(last, size[:live].astype(np.uint64) << np.uint64(56), np.uint64(0))
            state = [x[:live] for x in v]
            state[3] ^= chunk
            _sip_rounds(state, 2)
            state[0] ^= chunk
        v[2] ^= np.uint64(0xEE)
        _sip_rounds(v, 4)
        out[0, own] = v[0] ^ v[1] ^ v[2] ^ v[3]
        v[1] ^= np.uint64(0xDD)
        _sip_rounds(v, 4)
        out[1, own] = v[0] ^ v[1] ^ v[2] ^ v[3]
    for i in np.flatnonzero(lengths > 256).tolist():
        word = buf[starts[i] : starts[i] + lengths[i]].tobytes()
        out[:, i] = np.frombuffer(hashlib.blake2b(word, digest_size=16, key=key).digest(), "<u8")
    return out


def shingles(buf: np.ndarray, bounds: np.ndarray, n: int, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two rows, of all n-word shingles (repeats too) and where each text's
    begin.  A text of 1 to n-1 words has one of all its words; one without words none."""
    rows = len(bounds) - 1
    sizes = np.diff(bounds) + 1
    padded = np.full(len(buf) + rows, 32, np.uint8)
    keep = np.ones(len(padded), bool)
    ends = np.cumsum(sizes)
    keep[ends - 1] = False
    padded[keep] = FOLD[buf]
    word = ~SPACE[padded]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=np.int8(0)))
    starts, stops = edge[::2], edge[1::2]
    h = word_lanes(padded, starts, stops - starts, key)
    first = np.searchsorted(starts, ends - sizes)
    count = np.diff(np.append(first, len(starts)))
    out = h.copy()
    usable = h.shape[1] - n + 1
    if usable > 0:
        s = np.full((2, usable), n, np.uint64)
        for k in range(n):
            s = mix(s * MIX_A + h[:, k : k + usable])
        out[:, :usable] = s
    full = count >= n
    number = np.where(full, count - n + 1, np.minimum(count, 1))
    for i in np.flatnonzero((count > 0) & ~full):
        s = np.full((2, 1), count[i], np.uint64)
        for k in range(count[i]):
            s = mix(s * MIX_A + h[:, first[i] + k : first[i] + k + 1])
        out[:, first[i]] = s[:, 0]
    begin = np.cumsum(number) - number
    where = np.arange(int(number.sum())) + np.repeat(first - begin, number)
    return out[:, where], np.append(begin, number.sum())


def as_set(lanes: np.ndarray) -> np.ndarray:
    """Distinct columns, sorted by the first row, then by the second."""
    lanes = lanes[:, np.argsort(lanes[0], kind="stable")]
    twin = lanes[0, 1:] == lanes[0, :-1]
    if not twin.any():
        return lanes
    if (lanes[1, 1:] != lanes[1, :-1])[twin].any():  # equal in the first row alone
        lanes = lanes[:, np.lexsort((lanes[1], lanes[0]))]
    new = np.append(True, (lanes[:, 1:] != lanes[:, :-1]).any(axis=0))
    return lanes[:, new]


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets of 128-bit members."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), b.shape[1] - 1)
    half = b[0][at] == a[0]
    both = half & (b[1][at] == a[1])
    if half.sum() != both.sum():  # equal in the first row alone
        return len(set(zip(*a.tolist(), strict=True)) & set(zip(*b.tolist(), strict=True)))
    return int(both.sum())


def spare_parts(size: int, differ: int) -> int:
    """Parts beyond ``differ``: so many that a set of ``size`` shingles seldom leaves as
    many empty (their number is about Poisson), and three at least."""
    for spare in range(3, 2 * differ + 4):
        mean = (differ + spare) * math.exp(-size / (differ + spare))
        term = math.exp(-mean)
        below = term
        for k in range(1, spare):
            term *= mean / k
            below += term
        if 1 - below <= EMPTY_ODDS:
            return spare
    return 2 * differ + 3


class Bands:
    """Bands of set sizes; percent is the least similarity of a link."""

    def __init__(self, percent: int):
        self.percent, self.lows, self.known = percent, [1], {}

    def parts(self, band: int) -> tuple[int, int]:
        """Parts, and the most shingles in which linked sets of the band differ."""
        if band not in self.known:
            low, high = self.lows[band], self.lows[band + 1] - 1
            differ = (100 - self.percent) * 2 * high // (100 + self.percent)
            self.known[band] = (differ + spare_parts(-(-low * self.percent // 100), differ) if differ else 0, differ)
        return self.known[band]

    def levels(self, size: int) -> list[tuple[int, int, int]]:
        """(band, parts, most differing shingles) of each band in which a set of this
        size can be the smaller or larger of a linked pair."""
        while self.lows[-1] * self.percent <= size * 100:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND_GROWTH)))
        found = []
        for band in range(len(self.lows) - 2, -1, -1):
            if size >= self.lows[band + 1]:
                break
            if self.lows[band] * self.percent <= size * 100 and self.parts(band)[0]:
                found.append((band, *self.parts(band)))
        return found


def sketch(own: np.ndarray, band: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts that have shingles, their parity words and their XOR; own is sorted."""
    part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    parity = np.bitwise_xor.reduceat(np.uint64(1) << (own & np.uint64(63)), heads)
    return part[heads], parity, np.bitwise_xor.reduceat(own, heads)


def part_keys(own: np.ndarray, band: int, parts: int, differ: int) -> np.ndarray:
    """A key for each part with shingles.  Linked sets agree in parts - differ parts at
    least; a set with as many empty parts also gives their keys, since all parts in
    which it agrees with another may be empty."""
    where, parity, folded = sketch(own, band, parts)
    if parts - len(where) >= parts - differ:
        empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), where)
        where = np.concatenate([where, empty])
        parity, folded = (np.concatenate([x, np.zeros(len(empty), np.uint64)]) for x in (parity, folded))
    return mix(folded ^ mix(parity + (where + np.uint64(band << 32)) * MIX_A))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((a.shape[1], b.shape[1]))
    if 100 * small < percent * large:
        return False
    both = in_both(a, b)
    return 100 * both >= percent * (small + large - both)


def bit_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of one-bit parities per set; the Hamming distance of two rows is at most
    the symmetric difference of their sets."""
    found = [np.packbits((np.bincount((own[0] >> np.uint64(16)) & np.uint64(bits - 1), minlength=bits) & 1).astype(np.uint8)) for own in sets]
    return np.array(found, np.uint8).reshape(len(sets), bits // 8).view(np.uint64)


def block_links(left: list[tuple], right: list[tuple], sets: dict, percent: int) -> list[tuple[int, int]]:
    """Links that join the labels of two blocks of (class, label, star, far): pairs whose
    sketches differ by more than linked sets can, or that the triangle inequality rules
    out, are left out at once; the rest is compared exactly, and labels that a link has
    joined are not compared again."""
    a, b = [sets[m[0]] for m in left], [sets[m[0]] for m in right]
    n_a, n_b = np.array([x.shape[1] for x in a]), np.array([x.shape[1] for x in b])
    total = n_a[:, None] + n_b[None, :]
    bits = 1 << min(16, max(6, int(total.max() * 5 // 4).bit_length()))
    x, y = bit_sketches(a, bits), bit_sketches(b, bits)
    open_ = np.array([[p[1] != q[1] for q in right] for p in left])
    star_a, star_b = (np.array([m[2] for m in block], np.int64) for block in (left, right))
    far_a, far_b = (np.array([m[3] for m in block], np.int64) for block in (left, right))
    known = (star_a[:, None] == star_b[None, :]) & (far_a[:, None] >= 0) & (far_b[None, :] >= 0)
    low = np.where(known, np.abs(far_a[:, None] - far_b[None, :]), 0)
    for i in range(len(left)):
        if open_[i].any():
            low[i] = np.maximum(low[i], np.bitwise_count(x[i] ^ y).sum(axis=1))
    open_ &= low * (100 + percent) <= total * (100 - percent)
    links, joined = [], {}

    def root(v: int) -> int:
        while v in joined:
            v = joined[v]
        return v

    for i, j in zip(*np.nonzero(open_), strict=True):
        p, q = root(left[i][1]), root(right[j][1])
        if p != q and similar(a[i], b[j], percent):
            links.append((left[i][0], right[j][0]))
            joined[max(p, q)] = min(p, q)
    return links


# ---- connected components --------------------------------------------------


def local_roots(a: list[int], b: list[int]) -> dict[int, int]:
    """The smallest node reachable by these edges alone, for each of their nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """node, label: the smallest node of its component.

    Edges are dealt evenly to tasks of about EDGES_PER_TASK, each of which contracts its
    own.  A node that several tasks saw ties their roots together.  Those ties, a smaller
    graph over roots, go through rounds of joins by node until every root has its label:
    each node hands its least neighbour to its larger neighbours, then to its smaller ones.
    """
    shelf = shelf or Shelf(edges.sparkSession)
    edges = shelf.stage(edges.select("a", "b"), "edges")
    tasks = max(1, -(-edges.count() // EDGES_PER_TASK))

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += batch.column("a").to_pylist()
            b += batch.column("b").to_pylist()
        found = local_roots(a, b)
        yield pa.RecordBatch.from_pydict({"node": pa.array(found.keys(), pa.int64()), "label": pa.array(found.values(), pa.int64())})

    roots = shelf.stage(edges.repartition(tasks).mapInArrow(lean(contract), "node long, label long"), "roots")
    least = roots.groupBy("node").agg(F.min("label").alias("least"), F.count(F.lit(1)).alias("seen")).where("seen > 1")
    ties = join_groups(roots, least, "node", "seen", roots.count()).where("label <> least").select(F.col("label").alias("u"), F.col("least").alias("v")).distinct()
    ties = shelf.stage(ties, "ties")
    if not ties.head(1):
        return roots
    further = _stars(ties, shelf).select(F.col("u").alias("label"), F.col("v").alias("further"))
    whole = roots.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return shelf.stage(whole.groupBy("node").agg(F.min("label").alias("label")), "labels")


def _stars(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """u, v: every node u but the least of its component, and that least node v."""

    def hand_on(pairs: DataFrame, smaller: bool) -> DataFrame:
        # v's neighbours u: all of them, or only those below v (and v itself)
        rows = pairs if smaller else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rows = rows.select(F.col("u").alias("v"), F.col("v").alias("u")) if smaller else rows
        least = rows.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
        least = shelf.stage(least, "least")
        met = join_groups(rows, least, "v", "degree", rows.count())
        handed = met.where("u > v" if not smaller else "u <> m").select("u", F.col("m").alias("v"))
        own = least.where("m < v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return shelf.stage(handed.unionByName(own).where("u > v").distinct(), "stars")

    def state(pairs: DataFrame):
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    pairs = shelf.stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    while (now := state(pairs)) != before:
        before = now
        pairs = hand_on(hand_on(pairs, False), True)
    return pairs


# ---- the distributed steps -------------------------------------------------


def _sets(table: pa.RecordBatch, n: int, secret: bytes) -> Iterator[tuple[int, np.ndarray, bytes, bytes]]:
    """Place in the batch, set, digest of the set, and text of each row."""
    buf, bounds = flat(table.column("text"))
    for i, j in slices(bounds, 1 << 20):
        hashes, at = shingles(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], n, secret)
        at = at.tolist()
        for k in range(j - i):
            own = as_set(hashes[:, at[k] : at[k + 1]])
            yield i + k, own, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), buf[bounds[i + k] : bounds[i + k + 1]].tobytes()


DOC = np.dtype([("row", "<i8"), ("doc_id", "<i8"), ("null", "u1"), ("n", "<i8"), ("print", "<i8"), ("name", "<i8"), ("digest", "V16"), ("text_id", "V16")])
FOUND = "gid long, name long, row long, doc_id long, n long, print long, digest binary, text_id binary"


def _candidates(docs: DataFrame, n: int, percent: int, secret: bytes) -> DataFrame:
    """Rows of two kinds, committed: one of every document - row (a number of its own),
    doc_id, n, print, digest of its set, name (64 bits of the digest), text_id - and (gid,
    name) of every group of two or more names that share a key."""
    bits = max(4, int(np.ceil(np.log2(max(1, text_bytes(docs, "text") / BUCKET_BYTES)))))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        bands = Bands(percent)
        turn, row = 0, TaskContext.get().partitionId() << 33

        def message(rows: list[tuple], found: list[np.ndarray], owner: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            out = [(turn % (1 << bits), np.array(rows, DOC).tobytes(), None, None)]
            if found:
                key = np.concatenate(found)
                name = np.repeat(np.array([c for c, _ in owner], np.int64), [m for _, m in owner])
                order = np.argsort(key)
                key, name = key[order], name[order]
                at = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                out += [(b, None, key[at[b] : at[b + 1]].tobytes(), name[at[b] : at[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(at)).tolist()]
            columns = zip(("bucket", "docs", "keys", "names"), zip(*out, strict=True), strict=True)
            return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "bucket" else pa.binary()) for c, v in columns})

        rows, found, owner, held = [], [], [], 0
        for batch in batches:
            ids, prints = batch.column("doc_id").to_pylist(), batch.column("print").to_pylist()
            for i, own, digest, text in _sets(batch, n, secret):
                size, name = own.shape[1], int.from_bytes(digest[:8], "little", signed=True)
                rows.append((row, ids[i] or 0, ids[i] is None, size, prints[i], name, digest, hashlib.sha256(text).digest()[:16]))
                row += 1
                if size and digest not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(digest)
                    for band, parts, differ in bands.levels(size):
                        found.append(part_keys(own[0], band, parts, differ))
                        owner.append((name, len(found[-1])))
                        held += len(found[-1])
                if held >= 1 << 19 or len(rows) >= 20_000:
                    yield message(rows, found, owner)
                    rows, found, owner, held = [], [], [], 0
        if rows:
            yield message(rows, found, owner)

    def groups(table: pa.Table) -> pa.Table:
        own = np.frombuffer(flat(table.column("docs").drop_null())[0], DOC)
        key, name = (flat(table.column(c).drop_null())[0] for c in ("keys", "names"))
        key, name = key.view("<u8"), name.view("<i8")
        order = np.argsort(key)
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        twin = np.zeros(len(order), bool)
        twin[1:] |= same
        twin[:-1] |= same
        key, name = ordered[twin], name[order[twin]]
        del ordered, order
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))[: len(key)]
        key, name = key[new], name[new]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        gid, rows = np.zeros(0, np.int64), np.zeros(0, bool)
        if len(heads):
            sizes = np.diff(np.append(heads, len(key)))
            # groups with the same members, told apart by 128 bits, are one
            one, two = (np.add.reduceat(mix(name.view(np.uint64) * by + np.uint64(1)), heads) ^ mix(sizes.astype(np.uint64)) for by in (MIX_A, MIX_B))
            order = np.lexsort((two, one))
            fresh = np.append(True, (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]))
            keep = np.zeros(len(heads), bool)
            keep[order[fresh]] = True
            keep &= sizes > 1
            rows = np.repeat(keep, sizes)
            gid = np.repeat(one.view(np.int64), sizes)[rows]
        m, k = len(gid), len(own)
        number = lambda c: pa.chunked_array([pa.array(own[c]), pa.nulls(m, pa.int64())])
        fixed = lambda c: pa.chunked_array([pa.array(own[c].tolist(), pa.binary()), pa.nulls(m, pa.binary())])
        return pa.table({
            "gid": pa.chunked_array([pa.nulls(k, pa.int64()), pa.array(gid)]),
            "name": pa.chunked_array([pa.array(own["name"]), pa.array(name[rows])]),
            "row": number("row"),
            "doc_id": pa.chunked_array([pa.array(own["doc_id"], mask=own["null"] == 1), pa.nulls(m, pa.int64())]),
            "n": number("n"),
            "print": number("print"),
            "digest": fixed("digest"),
            "text_id": fixed("text_id"),
        })

    rows = docs.mapInArrow(lean(keys), "bucket int, docs binary, keys binary, names binary")
    return stage(rows.groupBy("bucket").applyInArrow(lean_group(groups), FOUND), "candidates")


def _bitmap(prints: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """One bit per print, 8 KiB to 32 MiB whatever the data: it thins the second scan
    out, and a join decides."""
    bits = min(BITMAP_HIGH, max(BITMAP_LOW, int(np.ceil(np.log2(16 * max(1, rows))))))
    chunk = 1 << min(bits, 20)

    def fill(table: pa.Table) -> pa.Table:
        bitmap = np.zeros(chunk, bool)
        bitmap[table.column("slot").to_numpy() % chunk] = True
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(bitmap).tobytes()], pa.binary())})

    slot = F.pmod("print", F.lit(1 << bits))
    found = prints.select(slot.alias("slot")).distinct().withColumn("chunk", F.expr(f"slot div {chunk}")).groupBy("chunk").applyInArrow(fill, "chunk long, bits binary")
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in found.collect():
        whole[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return whole, bits


def _store_sets(docs: DataFrame, wanted: DataFrame, n: int, secret: bytes, folder: str, shelf: Shelf) -> DataFrame:
    """class and set (file, at, size) of the wanted (class, digest, print)."""
    bitmap, bits = _bitmap(wanted, wanted.count())
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            slot = batch.column("print").to_numpy() % (1 << bits)
            batch = batch.filter(pa.array((held.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1))
            rows = {"digest": [], "print": [], "file": [], "at": [], "size": []}
            prints = batch.column("print").to_pylist()
            for i, own, digest, _ in _sets(batch, n, secret):
                out = out or BlobWriter(folder, ".set")
                for k, v in zip(rows, (digest, prints[i], out.file, out.append(blob := _dump(own)), len(blob)), strict=True):
                    rows[k].append(v)
            if rows["at"]:
                yield pa.RecordBatch.from_pydict({k: pa.array(v, {"file": pa.string(), "digest": pa.binary()}.get(k, pa.int64())) for k, v in rows.items()})
        if out is not None:
            out.close()

    sets = shelf.stage(docs.select("print", "text").mapInArrow(lean(write), "digest binary, print long, file string, at long, size long"), "set-places")
    held.destroy()
    # several rows with one print are copies of one text under one id
    return shelf.stage(sets.join(wanted.hint("merge"), ["digest", "print"]).groupBy("class").agg(F.min(F.struct("file", "at", "size")).alias("set")), "sets")


def _dump(own: np.ndarray) -> bytes:
    """96 bits of each member."""
    return own[0].tobytes() + (own[1] >> np.uint64(32)).astype("<u4").tobytes()


def _load(reader: BlobReader, place: dict) -> np.ndarray:
    blob, n = reader.get(place["file"], place["at"], place["size"]), place["size"] // 12
    return np.stack([np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<u4", n, 8 * n).astype(np.uint64)])


VERIFIED = "a long, b long, linked boolean, differ long"


def _verify(pairs: DataFrame, sets: DataFrame, folder: str, percent: int, shelf: Shelf) -> DataFrame:
    """The pairs (a, b) of classes, whether they are linked, and the size of their
    symmetric difference.  Many pairs may share a; a class is b once."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BlobReader(folder, 32 << 20)
        for batch in batches:
            linked, differ = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = _load(reader, x), _load(reader, y)
                both, total = in_both(a, b), a.shape[1] + b.shape[1]
                linked.append(100 * both >= percent * (total - both))
                differ.append(total - 2 * both)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_()), "differ": pa.array(differ, pa.int64())})

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rays")).join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a")
    placed = join_groups(pairs, shelf.stage(stars, "star-sets"), "a", "rays", pairs.count()).join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    placed = placed.select("a", "b", "x", "y").repartition(parts).sortWithinPartitions("x", "y")
    return shelf.stage(placed.mapInArrow(lean(check), VERIFIED), "verified")


def _verify_blocks(members: DataFrame, sets: DataFrame, folder: str, percent: int, shelf: Shelf) -> DataFrame:
    """Links (a, b) that join components, among all members (gid, size, class, label,
    star, far) of each group.  A group's members are dealt to blocks by a hash and every
    two blocks meet; a row of the join holds where the two blocks are, no members."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.greatest(F.lit(1), F.expr(f"(size + {MEMBERS - 1}) div {MEMBERS}"))
    dealt = members.withColumn("blocks", number).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    dealt = dealt.join(sets.hint("merge"), "class").groupBy("gid", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("class", "label", "star", "far", "set")).alias("members"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            places = []
            for rows in batch.column("members").to_pylist():
                out = out or BlobWriter(folder, ".blocks")
                blob = pickle.dumps([(m["class"], m["label"], m["star"] or 0, -1 if m["star"] is None else m["far"], m["set"]) for m in rows])
                places.append({"file": out.file, "at": out.append(blob), "size": len(blob)})
            yield pa.RecordBatch.from_pydict({"gid": batch.column("gid"), "block": batch.column("block"), "blocks": batch.column("blocks"), "place": pa.array(places, PLACE)})
        if out is not None:
            out.close()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, blocks = BlobReader(folder, 32 << 20), BlobReader(folder, 8 << 20)
        for batch in batches:
            links: list[tuple[int, int]] = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                left, right = (pickle.loads(blocks.get(p["file"], p["at"], p["size"])) for p in (x, y))
                if len({m[1] for m in left} | {m[1] for m in right}) > 1:
                    links += block_links(left, right, {m[0]: _load(reader, m[4]) for m in [*left, *right]}, percent)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    schema = "gid long, block long, blocks long, place struct<file:string,at:long,size:long>"
    blocks = shelf.stage(dealt.select("gid", "block", "blocks", "members").mapInArrow(lean(write), schema), "blocks")
    left = blocks.select("gid", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), F.col("place").alias("x"))
    pairs = left.join(blocks.select("gid", F.col("block").alias("other"), F.col("place").alias("y")).hint("merge"), ["gid", "other"])
    pairs = pairs.repartition(parts, F.xxhash64("gid", "other")).sortWithinPartitions("gid", "other").select("x", "y")
    return shelf.stage(pairs.mapInArrow(lean(check), "a long, b long").distinct(), "links")


PLACE = pa.struct([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def link(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (the smallest id reachable by
    links, its own included).

    Sets are linked when 100 * intersection >= percent * union.  A-Z count as a-z and
    words end at ASCII white space.  Null and wordless texts have empty sets and no
    links.  Rows that repeat an id are judged each by its own text.  Null ids give way to
    any other of their component, and a component of null ids alone has a null one.  An
    empty table gives an empty result; other columns are ignored.

    ``with_rows`` adds text_id (the first 16 bytes of the text's SHA-256) and stays, true
    for one row of each component (of the smallest id) and for rows with empty sets.
    """
    spark = docs.sparkSession
    docs = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("print", F.xxhash64("doc_id", "text"))
    secret, shelf = os.urandom(16), Shelf(spark)
    found = _candidates(docs, words, percent, secret)
    shelf.sweep()
    rows = found.where("row IS NOT NULL").drop("gid")
    first_of = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = shelf.stage(rows.where("n > 0").groupBy("digest", "name").agg(F.min("row").alias("class"), F.min(first_of).alias("least"), F.min("print").alias("print"), F.count(F.lit(1)).alias("copies")), "classes")
    # two sets with one name are both members of its groups, and form a group of their own
    shared = classes.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("name").alias("gid"), "name")
    groups = found.where("gid IS NOT NULL").select("gid", "name").unionByName(shared).distinct()
    groups = shelf.stage(groups.join(classes.select("name", "class").hint("merge"), "name").select("gid", "class").distinct(), "groups")
    number = groups.count()
    labels = None
    if number:
        folder = shelf.folder("sets")
        wanted = shelf.stage(classes.join(groups.select("class").distinct().hint("merge"), "class", "left_semi").select("class", "digest", "print"), "wanted")
        sets = _store_sets(docs, wanted, words, secret, folder, shelf)
        # the member that shares most keys is likely the text the others are copies of
        sizes = shelf.stage(groups.groupBy("gid").agg(F.count(F.lit(1)).alias("size")), "sizes")
        groups = shelf.stage(join_groups(groups, sizes, "gid", "size", number), "sized")
        weight = groups.groupBy("class").agg(F.sum("size").alias("weight"))
        heavy = groups.join(weight.hint("merge"), "class")
        stars = shelf.stage(heavy.groupBy("gid", "size").agg(F.max(F.struct("weight", "class")).alias("a")), "stars")
        first = join_groups(groups, stars.drop("size").withColumnRenamed("a", "star").join(sizes.withColumnRenamed("size", "many"), "gid"), "gid", "many", number)
        first = first.where(F.col("class") != F.col("star.class")).groupBy(F.col("class").alias("b")).agg(F.max("star").alias("a"))
        tested = _verify(shelf.stage(first.select("a.class", "b").toDF("a", "b"), "rays"), sets, folder, percent, shelf)
        edges = tested.where("linked").select("a", "b")
        labels = components(edges, shelf)
        shelf.sweep()
        # each class with its star and how far it is from it: two classes of one star
        # differ at least by the difference of their distances (triangle inequality)
        rays = tested.select(F.col("b").alias("class"), F.col("a").alias("star"), F.col("differ").alias("far"))
        members = groups.join(labels.withColumnRenamed("node", "class").hint("merge"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        members = shelf.stage(members, "members")
        split = members.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("many")).where("low <> high").select("gid", "many")
        members = join_groups(members, shelf.stage(split, "split"), "gid", "many", number).drop("many").join(rays.hint("merge"), "class", "left")
        labels = components(edges.union(_verify_blocks(shelf.stage(members, "open"), sets, folder, percent, shelf)), shelf)
    named = classes.withColumn("label", F.col("class"))
    if labels is not None:
        named = classes.join(labels.withColumnRenamed("node", "class").hint("merge"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = shelf.stage(named.select("class", "digest", "least", "copies", "label"), "named")
    whole = shelf.stage(named.groupBy("label").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("members")), "components")
    owned = stage(join_groups(named.drop("least"), whole, "label", "members", named.count()).select("digest", "copies", "first"), "owned")
    shelf.clear()
    filled = join_groups(rows.where("n > 0"), owned, "digest", "copies", rows.count())
    filled = filled.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), "text_id", (F.col("row") == F.col("first.row")).alias("stays"))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_id", F.lit(True).alias("stays"))
    out = filled.unionByName(empty)
    return out if with_rows else out.drop("text_id", "stays")
