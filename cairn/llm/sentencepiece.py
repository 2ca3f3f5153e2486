"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct segments of a batch (cut where characters meet that no piece has side by
side, so that no merge crosses; told apart by a 64-bit hash) are concatenated and indexed by a suffix array as deep as the longest piece.
Binary search finds every piece's range of occurrences; all occurrences are edges
(begin, end, piece), which are sorted by position and relaxed from left to right.

For a BPE model a path of least cost is not what the merges give, so an edge relaxes a
position only if its piece may follow the piece that ends where it begins: two pieces
may be neighbours if merging their joint text gives just these two.  A sequence is the
merges' result exactly if all its neighbours may be, so each position keeps one piece.
"""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.common import flat, kept, lean, own_columns, slices, spread
from cairn.llm.wordbpe import default_path, distinct_spans

BLANK = "▁"


class PieceModel:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str, remembered: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalisation is needed")
        kinds = [p.type for p in proto.pieces]
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte_ids = [0] * 256
        self.output: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if kinds[i] == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.output.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.output.append(p.piece.replace(BLANK, " ").encode() if kinds[i] == 1 else b"")
        self.sizes = np.array([len(b) for b in self.output], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.output), np.uint8)
        self.ids = {p: i for p, (_, i) in self.rank.items()}
        self._merge_trees()
        self.pieces = sorted(p for p in self.rank if p in self.right)
        self.longest = max(map(len, self.pieces))
        alphabet = sorted({c for p in self.rank for c in p})
        self.code = {c: i + 2 for i, c in enumerate(alphabet)}  # 0: end, 1: any other character
        self.table = np.ones(sys.maxunicode + 1, np.uint16)
        self.table[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        self.many = len(alphabet) + 2
        self.inside = np.zeros(self.many * self.many, bool)  # neighbours within some piece
        for p in self.rank:
            for x, y in zip(p[:-1], p[1:], strict=True):
                self.inside[self.code[x] * self.many + self.code[y]] = True
        self.width = -(-2 * self.longest // 8) * 8
        self.low = np.array([self._key(p) for p in self.pieces], f"S{self.width}")
        self.high = np.array([self._key(p).ljust(self.width, b"\xff") for p in self.pieces], f"S{self.width}")
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.most = remembered
        self.follows: dict[int, bool] = {}
        self._forget()

    def _merge_trees(self) -> None:
        """For every piece that its own merges build: the symbols at its right and at its
        left edge while it grows, each with the ranks at which it comes and goes."""
        symbols = {p: i for i, p in enumerate(dict.fromkeys([*self.rank, *(c for p in self.rank for c in p)]))}
        self.symbols, self.joined = symbols, {}
        for p, (rank, _) in self.rank.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    self.joined[symbols[p[:k]] << 32 | symbols[p[k:]]] = rank
        self.right: dict[str, list] = {}
        self.left: dict[str, list] = {}
        self.stepwise: set[str] = set()  # not in order of rank: checked by merging
        for p in self.rank:
            tree: dict[str, tuple[str, str]] = {}
            if self.merged(p, tree) != [p]:
                continue
            for edge, side in ((self.right, 1), (self.left, 0)):
                here, gone, path = p, math.inf, []
                while True:
                    come = self.rank[here][0] if here in tree else -math.inf
                    if come > gone:
                        self.stepwise.add(p)
                    path.append((symbols[here], come, gone))
                    if here not in tree:
                        break
                    here, gone = tree[here][side], come
                edge[p] = path

    def _key(self, piece: str) -> bytes:
        return b"".join(self.code[c].to_bytes(2, "big") for c in piece)

    def merged(self, text: str, tree: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The merges, step by step: best score first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[parts[i] + parts[i + 1]][0], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            if tree is not None:
                tree[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        """Whether no merge joins the last symbol of a and the first of b at any time
        while both are there.  The earlier goes first; of one rank, the left one: so all
        merges within a go before those of their rank within b, and the join of an edge
        goes after those of its rank within a and before those within b."""
        if a in self.stepwise or b in self.stepwise:
            return self.merged(a + b) == [a, b]
        for x, x_come, x_gone in self.right.get(a, ()):
            for y, y_come, y_gone in self.left.get(b, ()):
                rank = self.joined.get(x << 32 | y)
                if rank is not None:
                    when = max(rank, x_come, y_come)
                    if when < x_gone and when <= y_gone:
                        return False
        return True

    def segment(self, texts: list[str]) -> list[list[str]]:
        """The pieces of distinct segments (or characters that are no piece)."""
        joined = "\0".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        codes = self.table[points]
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes + 1) - 1
        codes[ends] = 0
        padded = np.concatenate([codes, np.zeros(self.width // 2, np.uint16)]).astype(">u2")
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width // 2)[: len(codes)])
        columns = windows.view(">u8").astype(np.uint64)
        order = np.lexsort(columns.T[::-1])
        ordered = windows.view(f"S{self.width}")[order, 0]
        low, high = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        number = high - low
        begin = order[spread(low, number)]
        piece = np.repeat(np.arange(len(self.pieces)), number)
        other = np.flatnonzero(codes == 1)  # characters that are no piece: edges of their own
        begin = np.concatenate([begin, other])
        piece = np.concatenate([piece, -1 - other])
        end = np.concatenate([begin[: len(piece) - len(other)] + self.lengths[piece[: len(piece) - len(other)]], other + 1])
        by_place = np.lexsort((begin, end))
        # of each position the piece that ends there: -1 none yet, -2 start of a segment
        at = [-1] * (len(codes) + 1)
        for i in (ends - sizes).tolist():
            at[i] = -2
        other_names = {-3 - int(i): joined[i] for i in other}
        piece[len(piece) - len(other) :] = -3 - other
        names, follows, many = self.pieces, self.follows, len(self.pieces)
        name = lambda i: names[i] if i >= 0 else other_names[i]
        for a, b, p in zip(begin[by_place].tolist(), end[by_place].tolist(), piece[by_place].tolist(), strict=True):
            before = at[a]
            if at[b] != -1 or before == -1:
                continue
            if before != -2:
                key = before * many + p
                good = follows.get(key) if before >= 0 and p >= 0 else None
                if good is None:
                    good = self.may_follow(name(before), name(p))
                    if before >= 0 and p >= 0:
                        if len(follows) > 400_000:
                            follows.clear()
                        follows[key] = good
                if not good:
                    continue
            at[b] = p
        found = []
        for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            parts, here = [], end
            while here > end - size:
                parts.append(name(at[here]))
                here -= len(parts[-1])
            found.append(parts[::-1])
        return found

    # -- whole texts

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.count = 0
        self.at, self.len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)

    def _learn(self, new: list[str]) -> None:
        ids: list[int] = []
        sizes = []
        for parts in self.segment(new):
            before = len(ids)
            for p in parts:
                i = self.ids.get(p)
                if i is None:
                    ids.extend(self.byte_ids[b] for b in p.encode())
                else:
                    ids.append(i)
            sizes.append(len(ids) - before)
        n = len(self.known)
        while self.count + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) > len(self.at):
            self.at, self.len = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.len, np.zeros_like(self.len)])
        self.flat[self.count : self.count + len(ids)] = ids
        self.len[n : n + len(new)] = sizes
        self.at[n : n + len(new)] = self.count + np.cumsum([0, *sizes[:-1]])
        self.count += len(ids)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's offset; null and empty: none.

        A segment ends where two characters meet that no piece has side by side, since
        no merge can cross there.
        """
        full = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        joined = "".join(full)
        bounds = np.cumsum([0, *map(len, full)])
        if not joined:
            return np.zeros(0, np.int32), bounds
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        codes = self.table[points].astype(np.int64)
        head = np.ones(len(codes), bool)
        head[1:] = ~self.inside[codes[:-1] * self.many + codes[1:]]
        head[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(head)
        lengths = np.diff(np.append(starts, len(codes)))
        index, heads = distinct_spans(points.view(np.uint8), starts * 4, lengths * 4)
        distinct = [joined[a : a + n] for a, n in zip(starts[heads].tolist(), lengths[heads].tolist(), strict=True)]
        if len(self.known) + len(distinct) > self.most:
            self._forget()
        if missing := [t for t in distinct if t not in self.known]:
            self._learn(missing)
        index = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[index]
        sizes = self.len[index]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[spread(self.at[index], sizes)], total[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: the pieces' bytes without the first space."""
        sizes = self.sizes[ids]
        data = self.bytes[spread(self.begins[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
        return [data[a:b].removeprefix(b" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]


_MODELS: dict[str, PieceModel] = kept({})


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), the
    SHA-256 of the decoded text, and whether it is the text itself; ``with_ids`` adds ids.

    Whole texts; null counts as empty, which has no ids.  A literal U+2581 decodes to a
    space, as in the library.  Other columns are ignored; no rows give no rows.
    """
    path = path or default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = flat(batch.column("text"))
            for i, j in slices(bounds, 4 << 20):
                m = model(path)
                ids, at = m.encode(batch.column("text").slice(i, j - i).to_pylist())
                texts, data = m.decode(ids, at), ids.astype("<u4")
                own = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                same = [t == buf[a:b].tobytes() for t, a, b in zip(texts, bounds[i:j].tolist(), bounds[i + 1 : j + 1].tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id").slice(i, j - i),
                    "n_ids": pa.array(np.diff(at)),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    "round_trip": pa.array(same, pa.bool_()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(lean(run, keeps=True), schema + (", ids array<int>" if with_ids else ""))
