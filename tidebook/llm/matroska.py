"""Media columns: payloads stored as Matroska files of 8-bit samples, and a parser that gives packet tables.

Fixed values: the element ids, types and defaults of the EBML and Matroska specifications (RFC 8794, RFC 9559).
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

from tidebook.llm.kernels import blocks
from tidebook.llm.runtime import id_text, small_batches

EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
DOC_TYPE, SCALE, NUMBER, UID, TYPE, CODEC, FREQUENCY, CHANNELS, BIT_DEPTH = 0x4282, 0x2AD7B1, 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, BLOCK, DURATION, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA1, 0x9B, 0xB3, 0xF7, 0xF1
CONTAINERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}

#: Samples a second, samples a frame, frames a laced block, frames a cluster: 8 ms frames.
RATE, FRAME, LACE, PER_CLUSTER = 64_000, 512, 8, 512


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones value of each width is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(time: int, frames: list[bytes], track: int = 1, lacing: str = "auto") -> bytes:
    """The body of a SimpleBlock. Lacing: none, fixed (equal sizes), ebml (differences) or xiph (runs of 255)."""
    sizes = [len(f) for f in frames]
    if lacing == "auto":
        lacing = "none" if len(frames) == 1 else "fixed" if len(set(sizes)) == 1 else "ebml"
    flag, lace = {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[lacing], b""
    if lacing != "none":
        lace = bytes([len(frames) - 1])
    if lacing == "xiph":
        lace += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        lace += size_bytes(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            lace += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return size_bytes(track) + struct.pack(">hB", time, 0x80 | flag) + lace + b"".join(frames)


def store(payload: bytes) -> bytes:
    """A Matroska file whose one track holds the payload as unsigned 8-bit samples."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    parts = [element(INFO, number(SCALE, 1_000_000) + element(0x4D80, b"tidebook") + element(0x5741, b"tidebook"))]
    parts.append(element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + number(0x9C, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio)))
    at, cues = sum(map(len, parts)), []
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ms = FRAME * 1000 // RATE
    for a in range(0, len(frames), PER_CLUSTER):
        body = [number(TIMESTAMP, a * ms)]
        body += [element(SIMPLE, _block((b - a) * ms, frames[b : min(b + LACE, a + PER_CLUSTER)])) for b in range(a, min(a + PER_CLUSTER, len(frames)), LACE)]
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE, number(CUE_TIME, a * ms) + element(CUE_AT, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in nanoseconds, first byte, end byte, key frame) of each frame, in file order
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    #: (time in nanoseconds, track, first byte of the cluster) of each cue
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    doc_type: str = ""
    scale: int = 1_000_000


def _varint(data: memoryview, i: int, keep: bool = False) -> tuple[int, int, int]:
    """Value, width and place after a variable-length integer; with ``keep`` the length marker stays (ids)."""
    if i >= len(data) or not data[i]:
        raise ValueError(f"no variable-length integer at byte {i}")
    width = 9 - data[i].bit_length()
    if i + width > len(data):
        raise ValueError(f"a variable-length integer is cut off at byte {i}")
    n = int.from_bytes(data[i : i + width], "big")
    return n if keep else n ^ 1 << 7 * width, width, i + width


def _frames(data: memoryview, i: int, end: int, lacing: int) -> list[tuple[int, int]]:
    if not lacing:
        return [(i, end)]
    count = data[i] + 1
    i += 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(count - 1):
            n = 0
            while data[i] == 255:
                n += 255
                i += 1
            sizes.append(n + data[i])
            i += 1
    elif lacing == 3:
        for k in range(count - 1):
            n, width, i = _varint(data, i)
            sizes.append(sizes[-1] + n - ((1 << 7 * width - 1) - 1) if k else n)
    else:
        if (end - i) % count:
            raise ValueError("fixed lacing over frames of unequal size")
        sizes = [(end - i) // count] * (count - 1)
    ends = np.cumsum([i, *sizes]).tolist()
    if ends[-1] > end or min(sizes, default=0) < 0:
        raise ValueError("laced frames pass the end of their block")
    return list(zip(ends, [*ends[1:], end], strict=True))


def parse(raw: bytes) -> Media:
    """Tracks, packets and cues of a Matroska or WebM file. Unknown elements are passed over; clusters and segments
    of unknown size end where an element of their own or a higher level begins."""
    data, media = memoryview(raw), Media()
    segment = cluster_time = 0
    times: list[tuple[int, int, int, int, bool]] = []

    def walk(i: int, end: int, parent: int, track: dict, cue: dict) -> int:
        nonlocal segment, cluster_time
        while i < end:
            ident, _, j = _varint(data, i, keep=True)
            n, width, j = _varint(data, j)
            unknown = n == (1 << 7 * width) - 1
            if parent == CLUSTER and ident in (CLUSTER, CUES, TRACKS, INFO, SEGMENT, 0x1254C367, 0x114D9B74, 0x1043A770, 0x1941A469):
                return i
            to = end if unknown else j + n
            if to > end:
                raise ValueError(f"element {ident:X} at byte {i} passes its parent's end")
            if ident in CONTAINERS:
                if ident == SEGMENT:
                    segment = j
                own_track, own_cue = ({} if ident == TRACK else track), ({} if ident == CUE else cue)
                to = walk(j, to, ident, own_track, own_cue)
                if ident == TRACK:
                    media.tracks[own_track.get("number", 0)] = own_track
                if ident == CUE_AT:
                    media.cues.append((cue.get("time", 0), cue.get("track", 0), segment + cue.get("cluster", 0)))
            else:
                body = data[j:to]
                if ident in (SIMPLE, BLOCK):
                    number_, _, k = _varint(data, j)
                    time, flags = struct.unpack_from(">hB", data, k)
                    for a, b in _frames(data, k + 3, to, flags >> 1 & 3):
                        times.append((number_, cluster_time + time, a, b, ident == SIMPLE and bool(flags & 0x80)))
                elif ident == DOC_TYPE:
                    media.doc_type = bytes(body).rstrip(b"\0").decode()
                elif ident == CODEC:
                    track["codec"] = bytes(body).rstrip(b"\0").decode()
                elif ident == FREQUENCY:
                    track["rate"] = struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
                elif ident in (NUMBER, TYPE, CHANNELS, BIT_DEPTH):
                    track[{NUMBER: "number", TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits"}[ident]] = int.from_bytes(body, "big")
                elif ident == SCALE:
                    media.scale = int.from_bytes(body, "big")
                elif ident == TIMESTAMP:
                    cluster_time = int.from_bytes(body, "big")
                elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                    cue[{CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}[ident]] = int.from_bytes(body, "big")
            i = to
        return i

    walk(0, len(data), 0, {}, {})
    # frames of one block share its time; in a track of known rate each starts where the one before ends
    last: tuple[int, int] | None = None
    offset = 0
    for number_, time, a, b, key in times:
        offset = offset if last == (number_, time) else 0
        last = (number_, time)
        track = media.tracks.get(number_, {})
        media.packets.append((number_, time * media.scale + (int(offset * 1_000_000_000 / track["rate"]) if track.get("rate") else 0), a, b, key))
        offset += (b - a) * 8 // max(8, track.get("bits", 8) * track.get("channels", 1))
    media.cues = [(t * media.scale, n, at) for t, n, at in media.cues]
    return media


def samples(raw: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets in file order."""
    return b"".join(raw[a:b] for n, _, a, b, _ in media.packets if n == track)


def feature(payload: bytes) -> str:
    """Level, energy, mid-line crossings and the counts of the eight amplitude bands, all whole numbers."""
    x = np.frombuffer(payload, np.uint8)
    y = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0)))
    bands = np.bincount(x >> 5, minlength=8)
    return f"sum={int(y.sum())};energy={int(y @ y)};crossings={crossings};bands={','.join(map(str, bands.tolist()))}"


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets"]
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets long"


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in blocks(batch, "text"):
            raw, rows = buf.tobytes(), []
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                stored = store(payload_of(raw[off[i] : off[i + 1]]))
                media = parse(stored)
                back = samples(stored, media)
                rows.append((doc, int(off[i + 1] - off[i]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back), len(media.packets)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)], NAMES)


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text (UTF-8, zero bytes up to a positive multiple of 64) as a Matroska file, parse it and
    describe what is read back. Null and empty texts are 64 zero bytes; null and repeated ids pass through; other
    columns are ignored; a narrow pass that holds a block of texts at a time."""
    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(_round_trip, SCHEMA)


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        for ident, raw in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            rows = [(ident, n, t, a, b - a, key) for n, t, a, b, key in parse(raw or b"").packets]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], ["id", "track", "timestamp_ns", "byte_start", "byte_length", "key_frame"])


def packet_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each packet of binary Matroska values: id, track, timestamp_ns, byte_start, byte_length, key_frame.
    Null or empty values have no packets; bytes that are no EBML raise."""
    from pyspark.sql import functions as F

    return media.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{media_col}`").alias("media")).mapInArrow(_packets, "id long, track int, timestamp_ns long, byte_start long, byte_length long, key_frame boolean")
