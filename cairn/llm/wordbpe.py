"""Exact, fast encoding with a ``tokenizers`` vocabulary of word-level BPE.

BPE never crosses a pre-token, so a text's ids are its pre-tokens' ids in a row.
Texts are lower-cased and cut into pre-tokens with numpy over whole batches; each
distinct pre-token goes through the library once and is then remembered under its own
bytes (hashes only sort and place; what they call equal is compared).  Texts with any character outside a plainly handled range (ASCII
without control characters, and two-byte Latin letters) and all texts for a
tokenizer of another make go through the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from cairn.llm.common import kept, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The normaliser and pre-tokeniser that the fast path reproduces (fixed values).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: Lower-cased bytes that send a text through the library whole: control characters,
#: Latin-1 signs (lead byte C2) and all characters past U+027F.
UNUSUAL = np.ones(256, bool)
UNUSUAL[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = False
UNUSUAL_TABLE = UNUSUAL.tobytes()
PAIRS = (b"\xc3\x97", b"\xc3\xb7", b"<|")


def unusual(data: bytes) -> np.ndarray:
    """Positions of such bytes, of the two signs among the Latin-1 letters, and
    of what may begin a special token."""
    found = np.frombuffer(data.translate(UNUSUAL_TABLE), bool)
    for pair in PAIRS:
        if pair in data:
            buf, found = np.frombuffer(data, np.uint8), found.copy()
            found[:-1] |= (buf[:-1] == pair[0]) & (buf[1:] == pair[1])
    return np.flatnonzero(found)

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[9, 10, 13, 32]] = SPACE
CLASSES[ord("a") : ord("z") + 1] = LETTER
CLASSES[0x80:] = LETTER
CLASSES[ord("0") : ord("9") + 1] = DIGIT
CLASSES_TABLE = CLASSES.tobytes()

MIX = np.uint64(0x9E3779B97F4A7C15)


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hash_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, all at once: eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    h = lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = lengths[live] - at
        chunk = words[starts[live] + at].copy().view("<u8")[:, 0]
        short = np.maximum(0, 8 - left).astype(np.uint64) * np.uint64(8)
        chunk = (chunk << short) >> short
        x = (h[live] ^ chunk) * MIX
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        h[live] = x ^ (x >> np.uint64(29))
        at += 8
        live = live[left > 8]
    return h


def equal_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the ranges of equal length at a and at b hold the same bytes."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    same, live, at = np.ones(len(a), bool), np.flatnonzero(lengths), 0
    while len(live):
        left = lengths[live] - at
        x, y = (words[side[live] + at].copy().view("<u8")[:, 0] for side in (a, b))
        short = np.maximum(0, 8 - left).astype(np.uint64) * np.uint64(8)
        good = (x << short) == (y << short)
        same[live[~good]] = False
        at += 8
        live = live[good & (left > 8)]
    return same


def distinct_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte range the number of its value, and for each value a range that has
    it.  Exact: hashes only sort the ranges, and each is compared with the one it is
    taken to equal.  (Among ranges of one length up to 8 bytes the hash is one to one.)
    """
    hashes = hash_spans(buf, starts, lengths)
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    np.not_equal(hashes[order[1:]], hashes[order[:-1]], out=new[1:])
    index, heads = np.empty(len(order), np.int64), order[new]
    index[order] = np.cumsum(new) - 1
    like = heads[index]
    wrong = lengths != lengths[like]
    long = np.flatnonzero(~wrong & (lengths > 8) & (like != np.arange(len(like))))
    wrong[long] = ~equal_spans(buf, starts[long], starts[like[long]], lengths[long])
    odd = np.flatnonzero(wrong)
    if len(odd):
        numbers: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            key = buf[starts[i] : starts[i] + lengths[i]].tobytes()
            if key not in numbers:
                numbers[key] = len(heads) + len(more)
                more.append(i)
            index[i] = numbers[key]
        heads = np.append(heads, more)
    return index, heads


class Words:
    """Numbers of words of 1 to 16 bytes, none of them NUL, by open addressing; found and
    entered a batch at a time.  A word's bytes, with NULs behind, are its two keys."""

    def __init__(self):
        self._empty(1 << 16)
        self.held = 0

    def _empty(self, size: int) -> None:
        self.low, self.high, self.number = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)

    @staticmethod
    def keys(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        low, high = eight[starts], np.zeros(len(starts), np.uint64)
        spare = (np.maximum(0, 8 - lengths) * 8).astype(np.uint64)
        low = (low << spare) >> spare
        long = np.flatnonzero(lengths > 8)
        spare = ((16 - lengths[long]) * 8).astype(np.uint64)
        high[long] = (eight[starts[long] + 8] << spare) >> spare
        return low, high

    def _places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0xD6E8FEB86659FD93))) * MIX
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(65 - len(self.low).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for unknown ones."""
        place = self._places(low, high)
        there = self.low[place]
        same = (there == low) & (self.high[place] == high)
        found = np.where(same, self.number[place], np.int32(-1))
        live = np.flatnonzero(~same & (there != 0))
        while len(live):
            place[live] = next_place = (place[live] + 1) & (len(self.low) - 1)
            there = self.low[next_place]
            same = (there == low[live]) & (self.high[next_place] == high[live])
            found[live[same]] = self.number[next_place[same]]
            live = live[~same & (there != 0)]
        return found

    def enter(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Adds distinct words that are not there yet."""
        self.held += len(low)
        if 2 * self.held > len(self.low):
            full = self.low != 0
            low, high, number = (np.concatenate([old[full], new]) for old, new in ((self.low, low), (self.high, high), (self.number, number)))
            self._empty(1 << (4 * self.held - 1).bit_length())
        place, live = self._places(low, high), np.arange(len(low))
        while len(live):
            at = place[live]
            free = self.low[at] == 0
            self.number[at[free]] = number[live[free]]  # of several words one stays
            won = free.copy()
            won[free] = self.number[at[free]] == number[live[free]]
            self.low[at[won]], self.high[at[won]] = low[live[won]], high[live[won]]
            live = live[~won]
            place[live] = (place[live] + 1) & (len(self.low) - 1)


def pretokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pre-tokens of lower-cased bytes."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.frombuffer(buf.tobytes().translate(CLASSES_TABLE), np.uint8)
    first = np.empty(len(buf), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == DIGIT
    quotes = np.flatnonzero(buf == 39)
    if len(quotes):
        quotes = quotes[(quotes == 0) | (kind[quotes - 1] != OTHER)]
        tail = np.concatenate([buf, np.zeros(3, np.uint8)])
        a, b = tail[quotes + 1], tail[quotes + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for found, size in ((quotes[one], 2), (quotes[two & ~one], 3)):
            first[found + 1] = False
            after = found + size
            first[after[after < len(buf)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(buf))
    keep = kind[starts] != SPACE
    return starts[keep], (ends - starts)[keep]


class Encoder:
    """``encode(texts)`` gives all ids in a row and each text's offset there."""

    def __init__(self, path: str, remembered: int = 700_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.fast = self._reproduced(spec)
        self.most = remembered
        if self.fast:
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
            self.words = Tokenizer.from_str(json.dumps(spec))
            vocab = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self._forget()

    @staticmethod
    def _reproduced(spec: dict) -> bool:
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        return (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"}
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": WORD_PATTERN}
            and cuts[0]["invert"]
            and spec["model"].get("end_of_word_suffix") == WORD_END
        )

    def _forget(self) -> None:
        self.words_known, self.long, self.count = Words(), {}, 0  # long: words of over 16 bytes
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.at = np.zeros(1 << 16, np.int64)
        self.len = np.zeros(1 << 16, np.int32)

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 512):
            part = [w.decode() for w in words[i : i + 512]]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):  # not one end to each word: one by one
                each = [np.array(self.words.encode(w, add_special_tokens=False).ids, np.int32) for w in part]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            n = self.count
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(part) > len(self.at):
                self.at, self.len = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.len, np.zeros_like(self.len)])
            self.ids[self.used : self.used + len(ids)] = ids
            begins = np.concatenate([[0], ends[:-1]])
            self.at[n : n + len(part)] = self.used + begins
            self.len[n : n + len(part)] = ends - begins
            self.used += len(ids)
            self.count += len(part)

    def _numbers(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word; new ones are learnt."""
        data, short = buf.tobytes(), np.flatnonzero(lengths <= 16)
        low, high = Words.keys(buf, starts[short], lengths[short])
        index = np.full(len(starts), -1, np.int32)
        index[short] = self.words_known.find(low, high)
        if len(short) < len(starts):
            rest = np.flatnonzero(lengths > 16)
            number, heads = distinct_spans(buf, starts[rest], lengths[rest])
            known = [self.long.get(data[a : a + n], -1) for a, n in zip(starts[rest[heads]].tolist(), lengths[rest[heads]].tolist(), strict=True)]
            index[rest] = np.array(known, np.int32)[number]
        missing = np.flatnonzero(index < 0)
        if not len(missing):
            return index
        number, heads = distinct_spans(buf, starts[missing], lengths[missing])
        if self.count and self.count + len(heads) > self.most:
            self._forget()
            return self._numbers(buf, starts, lengths)
        at, new = missing[heads], self.count + np.arange(len(heads), dtype=np.int32)
        words = [data[a : a + n] for a, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
        self._learn(words)
        brief = lengths[at] <= 16
        self.words_known.enter(*Words.keys(buf, starts[at[brief]], lengths[at[brief]]), new[brief])
        self.long.update((words[i], int(new[i])) for i in np.flatnonzero(~brief).tolist())
        index[missing] = new[number]
        return index

    def _plain(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """buf: lower-cased texts, each with a line end; bounds: where they begin."""
        starts, lengths = pretokens(buf)
        index = self._numbers(buf, starts, lengths)
        sizes = self.len[index].astype(np.int64)
        ids = self.ids[spread(self.at[index], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.searchsorted(starts, bounds)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or "" for t in texts]
        if not texts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        if not self.fast:
            plain = np.zeros(len(texts), bool)
        else:
            lowered = [t.lower().encode() for t in texts]
            data = b"\n".join([*lowered, b""])
            bounds = np.cumsum([0, *(len(t) + 1 for t in lowered)])
            odd = unusual(data)
            if not len(odd):
                return self._plain(np.frombuffer(data, np.uint8), bounds)
            plain = np.ones(len(texts), bool)
            plain[np.searchsorted(bounds, odd, "right") - 1] = False
        each: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        where = np.flatnonzero(plain)
        if len(where):
            some = b"\n".join([*(lowered[i] for i in where), b""])
            ids, at = self._plain(np.frombuffer(some, np.uint8), np.cumsum([0, *(len(lowered[i]) + 1 for i in where)]))
            for k, i in enumerate(where):
                each[i] = ids[at[k] : at[k + 1]]
        for i, p in enumerate(plain):
            if not p:
                each[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(each), np.cumsum([0, *(len(x) for x in each)])


_ENCODERS: dict[str, Encoder] = kept({})


def encoder(path: str) -> Encoder:
    """One to a worker process; its memory of words outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each document."""
    if end_id is None:
        return ids, at
    n = len(at) - 1
    out = np.full(len(ids) + n, end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[at[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, at + np.arange(n + 1)
