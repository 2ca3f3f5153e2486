"""Media columns in Matroska: bytes as 8-bit audio samples, and packet tables.

``mux`` writes a file of one PCM track: EBML header, segment information, track, cue
table, and clusters of simple blocks whose frames are laced.  ``packets`` reads such
files (and any with the same elements, unknown ones skipped) back into a table of
packets with track, timestamp, byte range, cluster and keyframe flag, whatever the
lacing: none, Xiph, EBML or fixed size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.common import flat, lean, own_columns, slices, stage

#: Fixed values of the Matroska format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
#: Elements that only a segment holds: they end a cluster of unknown size.
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

SAMPLE_RATE = 8000
UNIT = 192
FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 192, 40, 8
FRAME_MS = 1000 * FRAME // SAMPLE_RATE


# ---- writing ---------------------------------------------------------------


def element_id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def vint(number: int, width: int | None = None) -> bytes:
    """A size: the first set bit tells the width; all ones are kept for 'unknown'."""
    width = width or next(w for w in range(1, 9) if number < (1 << (7 * w)) - 1)
    return (number | 1 << (7 * width)).to_bytes(width, "big")


def element(number: int, content: bytes) -> bytes:
    return element_id(number) + vint(len(content)) + content


def unsigned(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """Body of a block after its flags."""
    if lacing == NO_LACING:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == XIPH_LACING:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for before, n in zip(sizes[:-2], sizes[1:-1], strict=True):
            step = n - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << (7 * w - 1)) - 1)
            head += vint(step + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def block(frames: list[bytes], relative: int, lacing: int, track: int = 1) -> bytes:
    return vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1) + lace(frames, lacing)


_HEADER = element(
    EBML,
    unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + unsigned(DEFAULT_DURATION, FRAME_MS * 1_000_000)
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", SAMPLE_RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file of the payload's samples; it depends on the payload alone.

    Whole blocks use fixed-size lacing (frames are alike), a single frame none.
    """
    if len(payload) % UNIT or not payload:
        raise ValueError(f"payload must be a positive multiple of {UNIT} bytes")
    per_block = FRAME * FRAMES_PER_BLOCK
    per_cluster = per_block * BLOCKS_PER_CLUSTER
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", 1000 * len(payload) / SAMPLE_RATE)) + element(MUXING_APP, b"cairn") + element(WRITING_APP, b"cairn"))
    clusters, times = [], []
    for begin in range(0, len(payload), per_cluster):
        time = begin // FRAME * FRAME_MS
        body = [unsigned(TIMESTAMP, time)]
        for at in range(begin, min(begin + per_cluster, len(payload)), per_block):
            frames = [payload[i : i + FRAME] for i in range(at, min(at + per_block, len(payload)), FRAME)]
            body.append(element(SIMPLE_BLOCK, block(frames, at // FRAME * FRAME_MS - time, FIXED_LACING if len(frames) > 1 else NO_LACING)))
        clusters.append(element(CLUSTER, b"".join(body)))
        times.append(time)
    # positions in the cues count from the segment's content and have 8 bytes, so the
    # size of the cue table doesn't depend on them
    def cue(time: int, position: int) -> bytes:
        place = unsigned(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, position.to_bytes(8, "big"))
        return element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, place))

    at = len(info) + len(_TRACKS) + len(element(CUES, b"".join(cue(t, 0) for t in times)))
    cues = []
    for time, cluster in zip(times, clusters, strict=True):
        cues.append(cue(time, at))
        at += len(cluster)
    return _HEADER + element(SEGMENT, b"".join([info, _TRACKS, element(CUES, b"".join(cues)), *clusters]))


# ---- reading ---------------------------------------------------------------


def read_id(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if not first >> 4:
        raise ValueError(f"no element id at {at}")
    width = 9 - first.bit_length()
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_vint(data: bytes, at: int) -> tuple[int | None, int]:
    """Value (None: unknown size) and the place after it."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + width], "big") & ((1 << (7 * width)) - 1)
    return None if value == (1 << (7 * width)) - 1 else value, at + width


def unlace(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block's body."""
    if lacing == NO_LACING:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    if lacing == FIXED_LACING:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [size] * count
    else:
        sizes = []
        for i in range(count - 1):
            if lacing == XIPH_LACING:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                before = at
                value, at = read_vint(data, at)
                value = (1 << (7 * (at - before))) - 1 if value is None else value
                size = value if not i else sizes[-1] + value - ((1 << (7 * (at - before) - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    ranges = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("frames exceed their block")
        ranges.append((at, at + size))
        at += size
    return ranges


@dataclass
class Movie:
    """What a file holds.  packets: (track, timestamp ms, begin, end, cluster, keyframe)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, float, int, int, int, bool]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Id, place, content's begin and end of each element.  A cluster of unknown size
    ends at the next element that only a segment holds or with its parent, a segment of
    unknown size at the next EBML header or with the data."""
    while at < end:
        begin = at
        number, at = read_id(data, at)
        size, at = read_vint(data, at)
        stop = at + size if size is not None else _open_end(data, at, end, {SEGMENT: {EBML, SEGMENT}, CLUSTER: TOP_LEVEL | {EBML, SEGMENT}}.get(number, set()))
        if stop > end:
            raise ValueError(f"element at {begin} exceeds its parent")
        yield number, begin, at, stop
        at = stop


def _open_end(data: bytes, at: int, end: int, enders: set[int]) -> int:
    """Where an element of unknown size ends whose content begins at ``at``."""
    while at < end:
        number, body = read_id(data, at)
        if number in enders:
            return at
        size, body = read_vint(data, body)
        # an open child has the same enders or ends where they are looked for next
        at = body if size is None else body + size
    return end


def _value(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def demux(data: bytes) -> Movie:
    movie, segment = Movie(), 0

    def frames(at: int, end: int, time: int, cluster: int, keyframe: bool | None) -> None:
        track, at = read_vint(data, at)
        relative, flags = struct.unpack_from(">hB", data, at)
        step = movie.tracks.get(track, {}).get("frame_ns", 0) / 1e6
        for i, (a, b) in enumerate(unlace(data, at + 3, end, flags >> 1 & 3)):
            movie.packets.append((track, (time + relative) * movie.scale / 1e6 + i * step, a, b, cluster, bool(flags & 0x80) if keyframe is None else keyframe))

    for number, _, at, end in _children(data, 0, len(data)):
        if number != SEGMENT:
            continue
        segment = at
        for kind, place, a, b in _children(data, at, end):
            if kind == INFO:
                for x, _, c, d in _children(data, a, b):
                    if x == TIMESTAMP_SCALE:
                        movie.scale = _value(data, c, d)
                    elif x == DURATION:
                        movie.duration = struct.unpack(">d" if d - c == 8 else ">f", data[c:d])[0]
            elif kind == TRACKS:
                for x, _, c, d in _children(data, a, b):
                    if x != TRACK_ENTRY:
                        continue
                    track = {"frame_ns": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0}
                    entry = list(_children(data, c, d))
                    for y, _, e, f in [*entry, *(z for k in entry if k[0] == AUDIO for z in _children(data, k[2], k[3]))]:
                        if y == TRACK_NUMBER:
                            movie.tracks[_value(data, e, f)] = track
                        elif y == DEFAULT_DURATION:
                            track["frame_ns"] = _value(data, e, f)
                        elif y == CODEC_ID:
                            track["codec"] = data[e:f].decode()
                        elif y == SAMPLING_FREQUENCY:
                            track["rate"] = struct.unpack(">d" if f - e == 8 else ">f", data[e:f])[0]
                        elif y in (CHANNELS, BIT_DEPTH):
                            track["channels" if y == CHANNELS else "bits"] = _value(data, e, f)
            elif kind == CUES:
                for x, _, c, d in _children(data, a, b):
                    time = track = position = 0
                    for y, _, e, f in _children(data, c, d) if x == CUE_POINT else ():
                        if y == CUE_TIME:
                            time = _value(data, e, f)
                        elif y == CUE_TRACK_POSITIONS:
                            for z, _, g, h in _children(data, e, f):
                                if z == CUE_TRACK:
                                    track = _value(data, g, h)
                                elif z == CUE_CLUSTER_POSITION:
                                    position = segment + _value(data, g, h)
                    movie.cues.append((time, track, position))
            elif kind == CLUSTER:
                movie.clusters.append(place)
                time = 0
                for x, _, c, d in _children(data, a, b):
                    if x == TIMESTAMP:
                        time = _value(data, c, d)
                    elif x == SIMPLE_BLOCK:
                        frames(c, d, time, len(movie.clusters) - 1, None)
                    elif x == BLOCK_GROUP:
                        group = list(_children(data, c, d))
                        referring = any(k[0] == 0xFB for k in group)
                        for y, _, e, f in group:
                            if y == BLOCK:
                                frames(e, f, time, len(movie.clusters) - 1, not referring)
    return movie


# ---- columns ---------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """Spaces up to a positive multiple of UNIT."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the file of each text (null: empty) in a binary column.
    Other columns are ignored; an empty table gives an empty column."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = flat(batch.column("text"))
            for i, j in slices(at, 4 << 20):
                files = [mux(padded(buf[a:b].tobytes())) for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "n_bytes": pa.array(np.diff(at[i : j + 1])), "media": pa.array(files, pa.binary())})

    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(lean(write), "doc_id long, n_bytes long, media binary")


PACKETS = "doc_id long, track int, packet long, timestamp_ms double, begin long, end long, cluster int, keyframe boolean, cued boolean"


def packets(media: DataFrame) -> DataFrame:
    """The packet table of a media column: one row per frame.  Null files have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKETS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if data is None:
                    continue
                movie = demux(data)
                cued = {p for _, _, p in movie.cues}
                rows = [(doc_id, t, i, ms, a, b, c, k, movie.clusters[c] in cued) for i, (t, ms, a, b, c, k) in enumerate(movie.packets)]
                if rows:
                    yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(names, zip(*rows, strict=True), types, strict=True)})

    return own_columns(media, "doc_id", "media").mapInArrow(read, PACKETS)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(data: bytes) -> tuple[bytes, str]:
    """Payload and features of a stored file: packets, clusters, cues that point to a
    cluster, last timestamp, and mean, deviation and crossings of the samples."""
    movie = demux(data)
    payload = b"".join(data[a:b] for _, _, a, b, _, _ in movie.packets)
    samples = np.frombuffer(payload, np.uint8)
    centred = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    right = sum(p in movie.clusters for _, _, p in movie.cues)
    track = movie.tracks[1]
    return payload, (
        f"{track['codec']} {track['rate']:.0f}Hz {track['bits']}bit packets={len(movie.packets)} clusters={len(movie.clusters)} cues={right} "
        f"last_ms={movie.packets[-1][1]:.0f} duration_ms={movie.duration:.0f} mean={samples.mean():.4f} deviation={samples.std():.4f} crossings={crossings}"
    )


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes say, one row per file; of a null file nothing (nulls)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column("doc_id"), batch.column("n_bytes")
            rows = []
            for i in range(len(batch)):
                data = batch.column("media")[i].as_py()
                if data is None:
                    rows.append((None,) * 6)
                    continue
                payload, feature = describe(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if rows:
                cols = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([ids, sizes, *cols], names=[x.split()[0] for x in FEATURES.split(", ")])

    return own_columns(media, "doc_id", "n_bytes", "media").mapInArrow(lean(read), FEATURES)


def store_and_describe(docs: DataFrame) -> DataFrame:
    """Write the media column to the shared folder, then read it back."""
    return features(stage(with_media(docs), "media"))
