"""MPEG audio columns: a payload stored in frames, and the timing of any such stream.

``media`` stores bytes in a variable-bitrate stream of MPEG-1 Layer III frames with checksums: silence, with the payload in
each frame's ancillary bytes, tags in front and behind, and a table of seek points. ``probe`` reads MPEG audio of all versions
and layers: it skips tags and junk, finds frame headers again after damage and in front (a first frame counts only if another
follows), verifies the checksums of all three layers, reads Xing, Info and VBRI tables with their seek points and holds them
against the frames that are there, and gives the exact duration in samples, less an encoder's delay and padding where the
table tells them, and the offset of every frame. Read are ID3v2.2 to 2.4 tags, also with extended headers and
unsynchronisation, ID3v1 and APEv2 tags. Not read: free-format streams, which count as junk, and encrypted or packed tag frames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.tables import slices, written

#: Fixed values of the format: kbit/s by (MPEG-1?, layer), sample rates by version bits, samples a frame.
_KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
BLOCK = 64


@dataclass(frozen=True)
class Header:
    size: int
    samples: int
    rate: int
    side: int
    protected: bool
    kind: tuple  # what all frames of a stream have in common
    kbits: int
    channels: int
    bound: int  # first subband that both channels share (Layers I and II)


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The meaning of four bytes as a frame header, if they are one (free format isn't taken)."""
    if four not in _HEADERS:
        if len(_HEADERS) > 100_000:
            _HEADERS.clear()
        _HEADERS[four] = _header(four)
    return _HEADERS[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    first, mono = version == 3, four[3] >> 6 == 3
    kbits, hertz, padding = _KBITS[first, layer][index - 1], _RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * kbits * 1000 // hertz + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + padding
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(size, samples, hertz, side, not four[1] & 1, (version, layer, rate), kbits, 1 if mono else 2, bound)


_CRCS: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The checksum of a frame, polynomial 0x8005 from 0xFFFF, over half its header and its side information."""
    if data not in _CRCS:
        if len(_CRCS) > 100_000:
            _CRCS.clear()
        value = 0xFFFF
        for byte in data:
            value ^= byte << 8
            for _ in range(8):
                value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        _CRCS[data] = value
    return _CRCS[data]


#: Fixed values of the format: of Layer II, (subbands, bits of an allocation) by bit rate a channel and sample rate.
_FEW_48K, _FEW_32K = ((2, 4), (6, 3)), ((2, 4), (10, 3))
_MANY, _MOST, _HALF_RATE = ((11, 4), (12, 3), (4, 2)), ((11, 4), (12, 3), (7, 2)), ((4, 4), (7, 3), (19, 2))


def allocation_widths(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a Layer I or II frame."""
    version, layer, rate = h.kind
    if layer == 1:
        return [4] * 32
    each = h.kbits // h.channels
    if version != 3:
        runs = _HALF_RATE
    elif each < 56:
        runs = _FEW_32K if rate == 2 else _FEW_48K
    else:
        runs = _MOST if each >= 96 and rate != 1 else _MANY
    return [bits for n, bits in runs for _ in range(n)]


def protected_bits(data: bytes, at: int, h: Header) -> int:
    """How many bits after the checksum it covers: allocations, and in Layer II what says which scale factors there are."""
    if h.side:
        return 8 * h.side
    bits, place, used = int.from_bytes(data[at : at + 64].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(allocation_widths(h)):
        channels = h.channels if band < h.bound else 1
        for _ in range(channels):
            place += width
            if bits >> (512 - place) & ((1 << width) - 1):
                used += 1 if channels == h.channels else h.channels
    return place + (2 * used if h.kind[1] == 2 else 0)


def checksum(data: bytes, at: int, h: Header) -> int:
    """The checksum that the protected frame at ``at`` should have."""
    head = at + 6
    n = protected_bits(data, head, h)
    value, rest = crc16(data[at + 2 : at + 4] + data[head : head + n // 8]), n % 8
    for bit in range(7, 7 - rest, -1):
        value ^= (data[head + n // 8] >> bit & 1) << 15
        value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


# ------------------------------------------------------------------------------------------------------------- writing


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text(name: str, value: str) -> bytes:
    body = b"\0" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + len(body).to_bytes(4, "big") + b"\0\0" + body


_SIZES = [(144 * k * 1000 // 44100, i + 1) for i, k in enumerate(_KBITS[True, 3])]
_ROOM = [(size - 6 - _SIDE, index) for size, index in _SIZES]
_HEADS: dict[int, bytes] = {}
for _, _i in _ROOM:
    _four = bytes([0xFF, 0xFA, _i << 4, 0xC0])
    _HEADS[_i] = _four + crc16(_four[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def media(payload: bytes) -> bytes:
    """The payload as a stream: tag, seek table, frames, tag."""
    frames, at, most = [], 0, _ROOM[-1][0]
    while at < len(payload):
        left = len(payload) - at
        room, index = _ROOM[-1] if left >= most else next(x for x in _ROOM if x[0] >= left)
        frames.append(_HEADS[index] + payload[at : at + room].ljust(room, b"\0"))
        at += room
    tags = _text("PAYLOAD_BYTES", str(len(payload))) + _text("PAYLOAD_CRC32", f"{zlib.crc32(payload):08x}")
    first = bytes([0xFF, 0xFB, 3 << 4, 0xC0])
    n_first = header(first).size
    total = n_first + sum(map(len, frames))
    starts, place = [], n_first
    for f in frames:
        starts.append(place)
        place += len(f)
    seek = bytes(min(255, starts[min(len(starts) - 1, i * len(starts) // 100)] * 256 // total) for i in range(100))
    table = b"Xing" + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + seek + (100).to_bytes(4, "big")
    return b"ID3\3\0\0" + _syncsafe(len(tags)) + tags + (first + bytes(_SIDE) + table).ljust(n_first, b"\0") + b"".join(frames) + b"TAG" + bytes(124) + b"\xff"


# ------------------------------------------------------------------------------------------------------------- reading


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    kbits: set[int] = field(default_factory=set)
    checked: int = 0
    damaged: int = 0
    resyncs: int = 0
    junk: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_at: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: list[int] = field(default_factory=list)  # places of the table's points, from its own frame on
    delay: int = 0
    padding: int = 0
    lies: list[str] = field(default_factory=list)  # what the table says and the frames don't
    ancillary: list[bytes] = field(default_factory=list)

    @property
    def duration(self) -> int:
        """Samples that are meant to be heard."""
        return max(0, self.samples - self.delay - self.padding)


def _safe(data: bytes) -> int:
    return int.from_bytes(data, "big") if len(data) != 4 else sum((b & 0x7F) << s for b, s in zip(data, (21, 14, 7, 0), strict=True))


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """Reads the tag at ``at``; where it ends."""
    version, flags, size = data[at + 3], data[at + 5], _safe(data[at + 6 : at + 10])
    end = at + 10 + size + (10 if version == 4 and flags & 0x10 else 0)  # a footer
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and version > 2:  # an extended header: in 2.3 its size is without its own four bytes
        p = _safe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    letters, head = (3, 6) if version == 2 else (4, 10)
    while p + head <= len(body) and body[p]:
        raw = body[p + letters : p + 2 * letters]
        n = _safe(raw) if version == 4 else int.from_bytes(raw, "big")
        name, own = body[p : p + letters].decode("latin-1"), body[p + head : p + head + n]
        packed = version == 4 and body[p + 9] & 0x0C or version == 3 and body[p + 9] & 0xC0
        if version == 4 and body[p + 9] & 0x01:  # a length in front
            own = own[4:]
        if version == 4 and (flags & 0x80 or body[p + 9] & 0x02):
            own = own.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and own and not packed:
            encoding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(own[0], "latin-1")
            parts = own[1:].decode(encoding, "replace").split("\0")
            own_name = name in ("TXXX", "TXX") and len(parts) > 1
            out.tags[parts[0] if own_name else name] = parts[1].lstrip("\ufeff") if own_name else parts[0]
        p += head + n
    return end


def _ape(data: bytes, end: int, out: Stream) -> int:
    """Reads an APE tag that ends at ``end``; where it begins, or ``end`` if there is none."""
    foot = data[max(0, end - 32) : end]
    if foot[:8] != b"APETAGEX" or len(foot) < 32:
        return end
    number = lambda p, of=foot: int.from_bytes(of[p : p + 4], "little")
    size, items, flags = number(12), number(16), number(20)
    p = end - size
    if p < 0:
        return end
    for _ in range(items):
        n, zero = number(p, data), data.find(b"\0", p + 8, end)
        if zero < 0 or zero + 1 + n > end:
            break
        if not number(p + 4, data) & 6:  # text
            out.tags.setdefault(data[p + 8 : zero].decode("latin-1"), data[zero + 1 : zero + 1 + n].decode("utf-8", "replace"))
        p = zero + 1 + n
    return end - size - (32 if flags >> 31 else 0)


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads the table of a variable-bitrate stream if the frame holds one instead of sound."""
    number = lambda p, n=4: int.from_bytes(data[p : p + n], "big")
    for place in (at + 4 + h.side, at + 6 + h.side):
        if data[place : place + 4] in (b"Xing", b"Info"):
            flags, p = number(place + 4), place + 8
            out.table, out.table_at = data[place : place + 4].decode(), at
            if flags & 1:
                out.table_frames, p = number(p), p + 4
            if flags & 2:
                out.table_bytes, p = number(p), p + 4
            if flags & 4:
                total = out.table_bytes or 0
                out.seek, p = [x * total // 256 for x in data[p : p + 100]], p + 100
            p += 4 * (flags >> 3 & 1)
            if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and p + 24 <= at + h.size:
                gaps = number(p + 21, 3)
                out.delay, out.padding = gaps >> 12, gaps & 0xFFF
            return True
    if data[at + 36 : at + 40] == b"VBRI":
        out.table, out.table_at, out.table_bytes, out.table_frames = "VBRI", at, number(at + 46), number(at + 50)
        entries, scale, width = number(at + 54, 2), number(at + 56, 2), number(at + 58, 2)
        place = h.size
        for k in range(entries if width in (1, 2, 3, 4) else 0):
            out.seek.append(place)
            place += scale * number(at + 62 + k * width, width)
        return True
    return False


def _held_against(out: Stream, end: int) -> None:
    """What the table says against what was found: counts, and seek points that lie beyond the frame they should lead to."""
    if not out.table or out.lies:
        return
    offsets = [x - out.table_at for x in out.offsets]
    if out.table_frames is not None and out.table_frames != len(offsets):
        out.lies.append("frames")
    if out.table_bytes is not None and out.table_bytes != end - out.table_at:
        out.lies.append("bytes")
    if out.seek and offsets:
        step = (out.table_bytes or 0) / 256 if out.table != "VBRI" else 0  # a point of a Xing table stands for so many bytes
        wanted = [offsets[min(len(offsets) - 1, i * len(offsets) // len(out.seek))] for i in range(len(out.seek))]
        near = step + max(b - a for a, b in zip(offsets, [*offsets[1:], end - out.table_at], strict=True))  # and a frame
        if any(abs(a - b) > near for a, b in zip(out.seek, wanted, strict=True)):
            out.lies.append("seek")


def _sync(data: bytes, at: int, kind: tuple | None, end: int) -> int:
    """The next place at which a frame begins: a header that another of its kind or the end of the frames follows."""
    while 0 <= (at := data.find(b"\xff", at)) < end:
        h = header(data[at : at + 4])
        if h and kind in (None, h.kind):
            after = at + h.size
            following = header(data[after : after + 4]) if after < end else None
            if after == end or following and following.kind == h.kind:
                return at
        at += 1
    return end


def probe(data: bytes, keep: bool = False) -> Stream:
    """Timing, tags and seek offsets of a stream; ``keep``: the ancillary bytes of its Layer III frames too."""
    out, at, kind = Stream(), 0, None
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        at = _id3v2(data, at, out)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        title = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
        if title:
            out.tags.setdefault("TIT2", title)
    end = max(at, _ape(data, end, out))
    while at < end:
        h = header(data[at : at + 4])
        # the first frame must be confirmed by another, as after damage
        if h is None or kind not in (None, h.kind) or at + h.size > end or kind is None and _sync(data, at, None, end) != at:
            found = _sync(data, at + 1, kind, end)
            out.resyncs, out.junk, at = out.resyncs + (found < end), out.junk + found - at, found
            continue
        if kind is None:
            kind, out.rate = h.kind, h.rate
            if _table(data, at, h, out):
                at += h.size
                continue
        if h.protected:
            good = checksum(data, at, h) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.checked, out.damaged = out.checked + good, out.damaged + (not good)
        out.offsets.append(at)
        out.samples += h.samples
        out.kbits.add(h.kbits)
        if keep and h.side:
            out.ancillary.append(data[at + 4 + 2 * h.protected + h.side : at + h.size])
        at += h.size
    _held_against(out, end)
    return out


def payload(data: bytes, found: Stream | None = None) -> bytes:
    """The payload of a stream that ``media`` has made; ``found``: its probe with the ancillary bytes kept."""
    found = found or probe(data, keep=True)
    out = b"".join(found.ancillary)[: int(found.tags["PAYLOAD_BYTES"])]
    if found.damaged or found.lies or f"{zlib.crc32(out):08x}" != found.tags["PAYLOAD_CRC32"]:
        raise ValueError("the payload isn't what was stored")
    return out


def feature(s: Stream) -> str:
    """The stream's figures on one line."""
    bits = f"{min(s.kbits)}-{max(s.kbits)}" if s.kbits else "-"
    return f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};kbit={bits};table={s.table or '-'}:{s.table_frames}:{len(s.seek)};lies={'+'.join(s.lies) or '-'};checked={s.checked};damaged={s.damaged};resyncs={s.resyncs};first={s.offsets[0] if s.offsets else '-'};last={s.offsets[-1] if s.offsets else '-'}"


# ------------------------------------------------------------------------------------------------------------- columns


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of ``docs`` (doc_id, text, others)."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([media(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n_bytes long, media binary")


def probed(rows: DataFrame) -> DataFrame:
    """What the stored bytes of ``rows`` (doc_id, n_bytes, media) hold; see ``op3``."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate long, seek_offsets array<long>"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def one(data: bytes) -> tuple:
        s = probe(data, keep=True)
        own = payload(data, s)
        return len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), s.duration, s.rate, s.offsets

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = list(zip(*(one(x.as_py()) for x in b.column(2)), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(read, schema)


def op3(docs: DataFrame) -> DataFrame:
    """Every text as UTF-8, filled up to a multiple of 64 bytes, stored as a stream in a table, and read back from that table.

    Null and empty texts are 64 bytes 0. Equal texts have equal values, so repeated rows do; a null id is kept. An empty
    table gives an empty result.
    """
    return probed(written(with_media(docs), "media"))
