"""Matroska files as packet tables: an EBML parser, and a writer for 8-bit sample tracks.

`parse` walks variable-length elements (unknown sizes too), and resolves clusters,
simple blocks and block groups with every kind of lacing into packets with track,
timestamp, byte range and key flag; cues become seek points, a table beside the packets'.
`seek` reads from a cue's cluster on and steps over the ones before by their sizes. Byte
ranges point into the stored file, so packets are read without copying it.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_arrow

# Element ids of the format.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367, SEGMENT, EBML}

SAMPLE_RATE = 8000
FRAME = 1024
FRAMES_PER_BLOCK = 4
BLOCKS_PER_CLUSTER = 4


class Damaged(ValueError):
    """The bytes are not a readable file of this format."""


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    start: int
    size: int
    key: bool


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, place of the cluster
    scale: int = 1_000_000
    duration: float = 0.0  # in ticks of the scale
    clusters: list[tuple[int, int, int]] = field(default_factory=list)  # place of the element, start and end of its content


def _vint(data, at: int, end: int, keep_marker: bool) -> tuple[int | None, int]:
    """(value, next place) of a variable-length integer; null for the all-ones unknown size."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"cut off at {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return raw, at + width
    value = raw & ((1 << 7 * width) - 1)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data, at: int, end: int, parent: int = 0):
    """(id, start of the content, end of the content) of the elements in a range; one of unknown size lasts until an element that cannot be its child."""
    while at < end:
        kind, at = _vint(data, at, end, True)
        size, at = _vint(data, at, end, False)
        if size is None:
            stop = at
            while stop < end:
                inner, body = _vint(data, stop, end, True)
                if inner in TOP_LEVEL and (kind != SEGMENT or inner in (SEGMENT, EBML)):
                    break
                length, body = _vint(data, body, end, False)
                stop = end if length is None else body + length
        else:
            stop = at + size
        if stop > end:
            raise Damaged(f"element {kind:X} at {at} passes the end of its parent")
        yield kind, at, stop
        at = stop


def _uint(data, a: int, b: int) -> int:
    if b - a > 8:
        raise Damaged(f"a number of {b - a} bytes at {a}")
    return int.from_bytes(data[a:b], "big")


def _float(data, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise Damaged(f"a float of {b - a} bytes at {a}")
    return float(np.frombuffer(bytes(data[a:b]), f">f{b - a}")[0]) if b > a else 0.0


def lace_sizes(data, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """(sizes of the frames, place of the first) of a block's body. lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise Damaged(f"no frame count at {at}")
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise Damaged(f"{end - at} bytes are not {count} equal frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Damaged("lacing is cut off")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            start = at
            size, at = _vint(data, at, end, False)
            if k:  # a difference, biased to the middle of its range
                width = at - start
                size = sizes[-1] + (size if size is not None else (1 << 7 * width) - 1) - ((1 << (7 * width - 1)) - 1)
            elif size is None:
                raise Damaged("a lace has no size")
        sizes.append(size)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise Damaged("lace sizes pass the block")
    return [*sizes, rest], at


def _block(data, a: int, b: int, cluster_time: int, media: Media, key: bool | None) -> None:
    track, at = _vint(data, a, b, False)
    if at + 3 > b:
        raise Damaged(f"block at {a} is cut off")
    ticks = cluster_time + int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    sizes, at = lace_sizes(data, at + 3, b, flags >> 1 & 3)
    step = media.tracks.get(track, {}).get("frame_ns", 0)
    for k, size in enumerate(sizes):
        when = ticks * media.scale + k * step
        if when.bit_length() > 63:
            raise Damaged(f"timestamp {when} is out of range")
        media.packets.append(Packet(track, when, at, size, bool(flags & 0x80) if key is None else key))
        at += size


def _info(view, a: int, b: int, media: Media) -> None:
    for kind, c, d in elements(view, a, b):
        if kind == TIMESTAMP_SCALE:
            media.scale = _uint(view, c, d)
        elif kind == DURATION:
            media.duration = _float(view, c, d)


def _tracks(view, a: int, b: int, media: Media) -> None:
    for kind, c, d in elements(view, a, b):
        if kind != TRACK:
            continue
        track = {x: (y, z) for x, y, z in elements(view, c, d)}
        number = _uint(view, *track[TRACK_NUMBER]) if TRACK_NUMBER in track else 0
        told = {"codec": bytes(view[slice(*track[CODEC])]).decode("ascii", "replace") if CODEC in track else "", "frame_ns": _uint(view, *track[DEFAULT_DURATION]) if DEFAULT_DURATION in track else 0}
        if AUDIO in track:
            audio = {x: (y, z) for x, y, z in elements(view, *track[AUDIO])}
            told |= {"rate": _float(view, *audio[RATE]) if RATE in audio else 8000.0, "bits": _uint(view, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else 0}
        media.tracks[number] = told


def _cluster(view, a: int, b: int, media: Media) -> None:
    time = 0
    for kind, c, d in elements(view, a, b):
        if kind == CLUSTER_TIME:
            time = _uint(view, c, d)
        elif kind == SIMPLE_BLOCK:
            _block(view, c, d, time, media, None)
        elif kind == BLOCK_GROUP:
            parts = list(elements(view, c, d))
            for x, y, z in parts:
                if x == BLOCK:
                    _block(view, y, z, time, media, all(p[0] != REFERENCE for p in parts))


def _cues(view, a: int, b: int, origin: int, media: Media) -> None:
    for kind, c, d in elements(view, a, b):
        if kind != CUE_POINT:
            continue
        point = list(elements(view, c, d))
        when = next((_uint(view, y, z) for x, y, z in point if x == CUE_TIME), 0) * media.scale
        for x, y, z in point:
            if x == CUE_POSITIONS:
                where = {p: _uint(view, q, r) for p, q, r in elements(view, y, z)}
                cue = (when, where.get(CUE_TRACK, 0), origin + where.get(CUE_CLUSTER, 0))
                if max(n.bit_length() for n in cue) > 63:
                    raise Damaged(f"cue {cue} is out of range")
                media.cues.append(cue)


def outline(data) -> Media:
    """Tracks, cues and the places of clusters, whose content is not read; Damaged if the elements cannot be read to their end."""
    media = Media()
    view = memoryview(data)
    kinds, cues = [], []
    for kind, a, b in elements(view, 0, len(view)):
        kinds.append(kind)
        if kind != SEGMENT:
            continue
        place = a
        for top, c, d in elements(view, a, b):
            if top == INFO:
                _info(view, c, d, media)
            elif top == TRACKS:
                _tracks(view, c, d, media)
            elif top == CLUSTER:
                media.clusters.append((place, c, d))
            elif top == CUES:
                cues.append((c, d, a))
            place = d
    if kinds[:1] != [EBML]:
        raise Damaged("no EBML header")
    for c, d, origin in cues:  # after the scale, which may stand behind them
        _cues(view, c, d, origin, media)
    return media


def parse(data) -> Media:
    """Tracks, packets, cues and clusters of a file; Damaged if it cannot be read to its end."""
    media = outline(data)
    view = memoryview(data)
    for _, a, b in media.clusters:
        _cluster(view, a, b, media)
    return media


def seek(data, track: int, from_ns: int) -> Media:
    """The file with the packets of `track` from `from_ns` on, in file order; of its clusters only those from the last cue at or before that time are read.

    Without such a cue, or where no cluster stands at its place, all clusters are read.
    """
    media = outline(data)
    view = memoryview(data)
    best = max(((when, place) for when, of, place in media.cues if of == track and when <= from_ns), default=None)
    places = [place for place, _, _ in media.clusters]
    media.clusters = media.clusters[places.index(best[1]) if best and best[1] in places else 0 :]
    for _, a, b in media.clusters:
        _cluster(view, a, b, media)
    media.packets = [p for p in media.packets if p.track == track and p.timestamp_ns >= from_ns]
    return media


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 3:
        head += _size(len(frames[0])) if len(frames) > 1 else b""
        for a, b in zip(frames, frames[1:-1], strict=False):
            biased = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(biased) < (1 << (7 * w - 1)) - 1)
            head += (biased + (1 << (7 * width - 1)) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A file with one unsigned 8-bit mono track whose samples are the payload. Blocks use the kinds of lacing in turn; each cluster has a cue."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    scale = 1_000_000_000 // SAMPLE_RATE  # a tick is a sample
    header = _element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
    info = _element(INFO, _number(TIMESTAMP_SCALE, scale) + _element(DURATION, np.array(len(payload), ">f8").tobytes()) + _element(0x4D80, b"veilspark") + _element(0x5741, b"veilspark"))
    audio = _element(AUDIO, _element(RATE, np.array(SAMPLE_RATE, ">f8").tobytes()) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    track = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, FRAME * scale) + audio
    body = [info, _element(TRACKS, _element(TRACK, track))]
    place = sum(map(len, body))
    cues, number, at = [], 0, 0
    while at < len(frames):
        first, blocks = at, []
        while at < len(frames) and len(blocks) < BLOCKS_PER_CLUSTER:
            lacing = number % 4
            part = frames[at : at + (1 if lacing == 0 else FRAMES_PER_BLOCK)]
            if lacing == 2 and len({len(f) for f in part}) > 1:
                lacing = 3
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + ((at - first) * FRAME).to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + _laced(part, lacing)))
            at, number = at + len(part), number + 1
        cluster = _element(CLUSTER, _number(CLUSTER_TIME, first * FRAME) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, first * FRAME) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return header + _element(SEGMENT, b"".join(body))


PACKETS = "array<struct<track:bigint,timestamp_ns:bigint,start:bigint,size:bigint,key:boolean>>"
CUE_ENTRIES = "array<struct<timestamp_ns:bigint,track:bigint,cluster:bigint>>"
ADDED = {"packets": PACKETS, "cues": CUE_ENTRIES, "n_cues": "bigint", "error": "string"}


def _tables(files: DataFrame, content: str, read) -> DataFrame:
    keep = [c for c in files.columns if c != content and c not in ADDED]
    out = files.select(*keep, *(F.lit(None).cast(kind).alias(name) for name, kind in ADDED.items()))

    def run(batches):
        numbers = lambda *names: [(n, pa.int64()) for n in names]
        kinds = (
            pa.list_(pa.struct([*numbers("track", "timestamp_ns", "start", "size"), ("key", pa.bool_())])),
            pa.list_(pa.struct(numbers("timestamp_ns", "track", "cluster"))), pa.int64(), pa.string(),
        )
        for batch in batches:
            rows = []
            for data in batch.column(content).to_pylist():
                try:
                    media = read(data) if data is not None else None
                    cues = media and [dict(zip(("timestamp_ns", "track", "cluster"), c, strict=True)) for c in media.cues]
                    rows.append((media and [vars(p) for p in media.packets], cues, media and len(cues), None))
                except Damaged as error:
                    rows.append((None, None, None, str(error)))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([*(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keep, *ADDED])

    return map_arrow(files.select(*keep, content), run, out.schema)


def packet_table(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` without `content`, and packets array<struct<track, timestamp_ns, start, size, key>>, cues array<struct<timestamp_ns, track, cluster>>, n_cues and error.

    Start is the packet's place in the stored bytes, cluster that of the cluster element. Null bytes have null packets
    and cues; bytes that are damaged too, and say so in `error`. Explode `packets` or `cues` for a row each. Columns of
    `files` with the added names are replaced.
    """
    return _tables(files, content, parse)


def packets_from(files: DataFrame, track: int, from_ns: int, content: str = "content") -> DataFrame:
    """As `packet_table`, with the packets of `track` from `from_ns` on alone, read from the cue before on."""
    return _tables(files, content, lambda data: seek(data, track, from_ns))


def padded(text: str | None) -> bytes:
    """The UTF-8 bytes of a text and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def features(samples: np.ndarray, media: Media) -> str:
    """Counts of packets, clusters, cues and samples, duration in seconds, and mean, level, zero crossings and peak of the samples around the middle value."""
    centred = samples.astype(np.int64) - 128
    crossings = int(((centred[1:] < 0) != (centred[:-1] < 0)).sum())
    mean = int(centred.sum()) / len(centred)
    level = (int((centred * centred).sum()) / len(centred)) ** 0.5
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};samples={len(samples)};seconds={media.duration * media.scale / 1e9:.6f};mean={mean:.6f};rms={level:.6f};crossings={crossings};peak={int(np.abs(centred).max())}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_and_read(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: its text as samples in a file, read back through the parser's byte ranges.

    Null and empty texts are 64 zero bytes. Equal texts have equal values. Repeated rows
    repeat; null ids stay null. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                stored = write(padded(text))
                media = parse(stored)
                view = memoryview(stored)
                payload = b"".join(view[p.start : p.start + p.size] for p in media.packets)
                rows.append((
                    doc, len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                    len(stored), hashlib.sha256(stored).hexdigest(), features(np.frombuffer(payload, np.uint8), media),
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def files(docs: DataFrame) -> DataFrame:
    """doc_id and content: the stored file of each text, for `packet_table` or a sink."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([write(padded(t)) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "content"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, content binary")
