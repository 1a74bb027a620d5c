"""MPEG audio columns: frames with resynchronised headers, tags, VBR tables, checksums and seek offsets.

`write_stream` stores bytes without loss in the ancillary data of silent Layer III frames (UTF-8 never
holds the byte 0xFF, so stored text cannot look like a frame header). `parse_stream` reads any MPEG-1,
2 or 2.5 audio stream of Layers I to III: it skips ID3 tags, finds frame headers again after junk, reads
Xing/Info and VBRI tables with their seek points and encoder delay, checks the checksums of all layers
and returns exact durations and frame offsets.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192

# Fixed values of the MPEG audio format: kbit/s by (version 1 or 2, layer), and Hz by version bits.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Bits of a Layer II bit allocation, from the lowest subband on, by table (MPEG-1 B.2a to B.2d, MPEG-2 B.1).
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "2": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    """One frame header."""

    version: int  # 1, 2 or 25
    layer: int
    has_crc: bool
    kbits: int
    hertz: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of side information (Layer III)


@lru_cache(maxsize=4096)
def read_header(four: bytes, free_size: int = 0) -> Header | None:
    """The header in these four bytes, if they are one.

    A free-format header states no bit rate; it counts only with the size of a frame without padding.
    """
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version_bits, layer = (four[1] >> 3) & 3, 4 - ((four[1] >> 1) & 3)
    rate, hz = four[2] >> 4, (four[2] >> 2) & 3
    if version_bits == 1 or layer == 4 or rate == 15 or hz == 3 or (rate == 0 and not free_size):
        return None
    v1 = version_bits == 3
    kbits, hertz = KBITS[(1 if v1 else 2, layer)][rate], HERTZ[version_bits][hz]
    padding, mono = (four[2] >> 1) & 1, four[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and not v1 else 1152
    unit = 4 if layer == 1 else 1
    size = free_size + padding * unit if rate == 0 else (samples // 8 * 1000 * kbits // hertz // unit + padding) * unit
    side = (17 if mono else 32) if v1 else (9 if mono else 17)
    kbits = kbits or round(free_size * 8 * hertz / samples / 1000)
    return Header(1 if v1 else 2 if version_bits == 2 else 25, layer, not four[1] & 1, kbits, hertz, mono, size, samples, side if layer == 3 else 0)


def free_frame_size(data: bytes, at: int, end: int) -> int:
    """The size without padding of the free-format frame at `at`: the way to the next header of its kind; 0 if there is none."""
    kind, hz = data[at + 1], data[at + 2] & 0x0C
    if data[at] != 0xFF or data[at + 2] >> 4:
        return 0
    p = data.find(bytes((0xFF, kind)), at + 24, end)
    while 0 <= p < end - 4:
        if data[p + 2] >> 4 == 0 and data[p + 2] & 0x0C == hz:
            unit = 4 if 4 - ((kind >> 1) & 3) == 1 else 1
            return p - at - ((data[at + 2] >> 1) & 1) * unit
        p = data.find(bytes((0xFF, kind)), p + 1, end)
    return 0


def _crc(value: int, bits: int) -> int:
    """The checksum of MPEG audio over so many bits of a number: polynomial 0x8005, all ones at first."""
    crc = 0xFFFF
    for k in range(bits - 1, -1, -1):
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ value >> k) & 1 else crc << 1) & 0xFFFF
    return crc


@lru_cache(maxsize=4096)
def crc16(covered: bytes, bits: int | None = None) -> int:
    """The checksum of the first so many bits (all unless told) of these bytes."""
    bits = 8 * len(covered) if bits is None else bits
    return _crc(int.from_bytes(covered, "big") >> (8 * len(covered) - bits), bits)


def _allocation_table(head: Header) -> str:
    if head.version != 1:
        return "2"
    each = head.kbits // (1 if head.mono else 2)
    if each >= 56 and (head.hertz == 48000 or each <= 80):
        return "a"
    if each >= 56:
        return "b"
    return "d" if head.hertz == 32000 else "c"


def covered_bits(frame: bytes, head: Header) -> int:
    """Bits after the checksum that it covers: side information, or the bit allocation and (Layer II) how scale factors are sent."""
    if head.layer == 3:
        return 8 * head.side
    channels, joint = (1 if head.mono else 2), frame[3] >> 6 == 1
    table = (4,) * 32 if head.layer == 1 else ALLOCATION[_allocation_table(head)]
    bound = min(len(table), 4 * (((frame[3] >> 4) & 3) + 1)) if joint else len(table)
    value, total = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6)
    at = selected = 0
    for band, n in enumerate(table):
        both = channels == 2 and band >= bound
        for _ in range(1 if both else channels):
            used = value >> max(0, total - at - n) & ((1 << n) - 1)
            at += n
            selected += bool(used) * (2 if both else 1)
    return at + (2 * selected if head.layer == 2 else 0)


def checksum_good(frame: bytes, head: Header) -> bool:
    """Whether the checksum after the header is that of the last two header bytes and of what it covers."""
    bits = covered_bits(frame, head)
    return crc16(frame[2:4] + frame[6 : 6 + (bits + 7) // 8], 16 + bits) == int.from_bytes(frame[4:6], "big")


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


@lru_cache(maxsize=64)
def _frame_start(rate: int) -> bytes:
    """Header, checksum and empty side information of a mono 48 kHz Layer III frame."""
    head = bytes((0xFF, 0xFA, rate << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


#: Bytes of data by bit rate index: at 48 kHz a frame of k kbit/s has 3 k bytes.
ROOM = {rate: 3 * k - len(_frame_start(1)) for rate, k in enumerate(KBITS[(1, 3)]) if rate}


def write_stream(payload: bytes, size: int) -> bytes:
    """A tagged variable-bitrate stream that carries the payload; size is its length before padding."""
    frames, at, most = [], 0, max(ROOM)
    while at < len(payload):
        rest = len(payload) - at
        rate = most if rest >= ROOM[most] else min(r for r, n in ROOM.items() if n >= rest)
        piece = payload[at : at + ROOM[rate]]
        frames.append(_frame_start(rate) + piece + bytes(ROOM[rate] - len(piece)))
        at += ROOM[rate]
    text = f"\0payload\0{len(payload)}/{size}".encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    table = bytes((0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0)) + bytes(17)
    total = 192 + sum(map(len, frames))
    ends = np.cumsum([192, *map(len, frames)])
    toc = bytes(min(255, int(ends[len(frames) * k // 100] * 256 // total)) for k in range(100))
    table += b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"ID3\x03\0\0" + _synchsafe(len(tag)) + tag + table + bytes(192 - len(table)) + b"".join(frames)


@dataclass
class Stream:
    """What parse_stream found."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    #: frames, bytes, delay and padding as the table says, and the offset of the frame that holds it
    vbr: dict[str, int] = field(default_factory=dict)
    #: (share of the duration, offset) of each seek point of the table
    seek: list[tuple[float, int]] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    junk: int = 0
    data: list[bytes] = field(default_factory=list)

    @property
    def samples(self) -> int:
        """Samples of all frames, less those that the encoder says it added."""
        return max(0, sum(h.samples for h in self.headers) - self.vbr.get("delay", 0) - self.vbr.get("padding", 0))

    def seek_error(self) -> float:
        """The furthest that a seek point lies from the frame at its share of the duration, as a share of the bytes; 0 without seek points."""
        if not self.seek or not self.offsets:
            return 0.0
        places = [self.offsets[min(len(self.offsets) - 1, int(share * len(self.offsets)))] for share, _ in self.seek]
        return max(abs(at - place) for (_, at), place in zip(self.seek, places, strict=True)) / max(1, self.vbr.get("bytes", 0) or self.offsets[-1])


def _safe(raw: bytes) -> int:
    """A number of seven bits a byte."""
    return sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=False))


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads the tag that starts here (versions 2.3 and 2.4; others are skipped); the offset after it."""
    major, flags, size = data[at + 3], data[at + 5], _safe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    body, p = data[at + 10 : end], 0
    if flags & 0x80 and major == 3:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40:
        p = 4 + int.from_bytes(body[:4], "big") if major == 3 else _safe(body[:4])
    while major in (3, 4) and p + 10 <= len(body) and body[p : p + 4].strip(b"\0"):
        raw = body[p + 4 : p + 8]
        n = int.from_bytes(raw, "big") if major == 3 else _safe(raw)
        value, name = body[p + 10 : p + 10 + n], body[p : p + 4].decode("latin-1")
        if major == 4 and body[p + 9] & 0x01:
            value = value[4:]  # the length before unsynchronisation
        if major == 4 and (body[p + 9] & 0x02 or flags & 0x80):
            value = value.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and value:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            parts = value[1:].decode(code, "replace").split("\0")
            if name == "TXXX" and len(parts) > 1:
                tags[f"TXXX:{parts[0]}"] = parts[1]
            else:
                tags[name] = parts[0]
        p += 10 + n
    return end + (10 if flags & 0x10 else 0)


def _vbr_table(frame: bytes, head: Header, at: int) -> tuple[dict[str, int], list[tuple[float, int]]]:
    """The Xing/Info or VBRI table of this frame and its seek points, if it has one; `at` is the frame's offset."""
    for start in (4 + head.side, 6 + head.side):
        if frame[start : start + 4] in (b"Xing", b"Info") and len(frame) >= start + 8:
            flags, p, out, seek = int.from_bytes(frame[start + 4 : start + 8], "big"), start + 8, {"at": at}, []
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(frame) >= p + 4:
                    out[name] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4 and len(frame) >= p + 100:
                seek = [(k / 100, at + frame[p + k] * out.get("bytes", 0) // 256) for k in range(100)]
                p += 100
            p += 4 if flags & 8 else 0
            if frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= p + 24:
                added = int.from_bytes(frame[p + 21 : p + 24], "big")
                out |= {"delay": added >> 12, "padding": added & 0xFFF}
            return out, seek
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        delay, n_bytes, frames = int.from_bytes(frame[42:44], "big"), int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        n, scale, width, each = (int.from_bytes(frame[k : k + 2], "big") for k in (54, 56, 58, 60))
        seek, place = [], at + head.size
        for k in range(n if 0 < width <= 4 and frames else 0):
            entry = frame[62 + k * width : 62 + (k + 1) * width]
            if len(entry) < width or k * each >= frames:
                break
            seek.append((k * each / frames, place))
            place += int.from_bytes(entry, "big") * scale
        return {"at": at, "bytes": n_bytes, "frames": frames, "delay": delay}, seek
    return {}, []


def parse_stream(data: bytes | None) -> Stream:
    """Reads a whole stream; what is no frame or tag counts as junk, and an empty or null stream has nothing."""
    out, at, data = Stream(), 0, data or b""
    end, locked, free_size = len(data), None, 0

    def tag_v1(p: int) -> bool:
        return p == end - 128 and data[p : p + 3] == b"TAG"

    def header(p: int) -> Header | None:
        nonlocal free_size
        four = data[p : p + 4]
        if len(four) == 4 and four[0] == 0xFF and four[2] >> 4 == 0:
            free_size = free_size or free_frame_size(data, p, end)
            return read_header(four, free_size)
        return read_header(four)

    while at < end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3v2(data, at, out.tags)
            continue
        if tag_v1(at):
            for name, low, high in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
                if value := data[at + low : at + high].split(b"\0")[0].decode("latin-1").strip():
                    out.tags.setdefault(name, value)
            break
        head = header(at)
        if head and at + head.size <= end:
            after, kind = at + head.size, (head.version, head.layer, head.hertz)
            following = header(after)
            # Out of step, a header counts only if one of its kind, a tag or the end follows its frame.
            if kind == locked or after == end or data[after : after + 3] == b"ID3" or tag_v1(after) or (following and (following.version, following.layer, following.hertz) == kind):
                frame, locked = data[at:after], kind
                table, seek = _vbr_table(frame, head, at) if head.layer == 3 and not out.headers and not out.vbr else ({}, [])
                if table:
                    out.vbr, out.seek = table, seek
                else:
                    if head.has_crc:
                        good = checksum_good(frame, head)
                        out.crc_good += good
                        out.crc_bad += not good
                    out.offsets.append(at)
                    out.headers.append(head)
                    out.data.append(frame[4 + 2 * head.has_crc + head.side :])
                at = after
                continue
        locked = None
        ends = (data.find(b"\xff", at + 1, end), data.find(b"ID3", at + 1, end), end - 128 if at < end - 128 and tag_v1(end - 128) else -1, end)
        step = min(x for x in ends if x > 0)
        out.junk += step - at
        at = step
    return out


def payload_of(stream: Stream) -> tuple[bytes, int]:
    """The bytes that write_stream stored and their number before padding; no bytes if it stored none."""
    sizes = stream.tags.get("TXXX:payload", "").split("/")
    if len(sizes) != 2 or not all(x.isdigit() for x in sizes):
        return b"", 0
    return b"".join(stream.data)[: int(sizes[0])], int(sizes[1])


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of bytes; the last element of each row is its size."""
    held, size = [], 0
    for *row, n in rows:
        held.append(row)
        size += n
        if size >= most or len(held) >= 5000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as an MPEG stream.

    A null text is empty. Rows with a null doc_id and repeated rows stay; other columns are ignored.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    media = write_stream(*padded(text.as_py()))
                    yield doc, media, len(media)

        yield from _batches(rows(), ["doc_id", "media"], [pa.int64(), pa.binary()])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fn, "doc_id long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """media (doc_id, media) with n_bytes, payload, duration_samples, hertz, offsets and feature.

    Streams are parsed whole; a stream without frames has no duration, and a null one is empty. Rows with a
    null doc_id and repeated rows stay; other columns are ignored; an empty table gives an empty table.
    feature sums up frames, exact
    duration, bit rates, checksums, junk and the payload's byte statistics.
    """

    def feature(stream: Stream, payload: bytes) -> str:
        rates = Counter(h.kbits for h in stream.headers)
        values = np.frombuffer(payload, np.uint8).astype(np.float64)
        low, high, mean, power = (int(values.min()), int(values.max()), values.mean(), ((values - values.mean()) ** 2).mean()) if len(values) else (0, 0, 0.0, 0.0)
        return f"frames={len(stream.headers)};samples={stream.samples};table_frames={stream.vbr.get('frames', -1)};rates={','.join(f'{k}x{n}' for k, n in sorted(rates.items()))};crc={stream.crc_good}/{stream.crc_bad};seek_points={len(stream.seek)};seek_error={stream.seek_error():.4f};junk={stream.junk};min={low};max={high};mean={mean:.4f};power={power:.4f}"

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = cell.as_py() or b""
                    stream = parse_stream(data)
                    payload, size = payload_of(stream)
                    yield doc, data, size, payload, stream.samples, stream.headers[0].hertz if stream.headers else None, stream.offsets, feature(stream, payload), len(data) + len(payload)

        yield from _batches(rows(), ["doc_id", "media", "n_bytes", "payload", "duration_samples", "hertz", "offsets", "feature"], [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string()])

    return media.select("doc_id", "media").mapInArrow(fn, "doc_id long, media binary, n_bytes long, payload binary, duration_samples long, hertz int, offsets array<long>, feature string")
