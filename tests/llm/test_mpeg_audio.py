import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import mpeg_audio as mpeg

DOCS = "doc_id long, text string, media string, n_bytes int"


@given(st.binary(max_size=9000))
@settings(max_examples=150, deadline=None)
def test_payload_comes_back(data):
    stored = mpeg.media(mpeg.padded(data))
    own = mpeg.payload(stored)
    assert own[: len(data)] == data and len(own) % 64 == 0 and len(own) > 0 and not own[len(data) :].strip(b"\0")
    s = mpeg.probe(stored)
    assert s.damaged == s.resyncs == s.junk == 0 and s.checked == len(s.offsets) == s.table_frames
    assert s.samples == 1152 * len(s.offsets) and s.rate == 44100 and s.table == "Xing"
    assert all(stored[o] == 0xFF and stored[o + 1] >> 5 == 7 for o in s.offsets)


def frame(body=b"", padding=0):
    """A 32 kbit/s, 44100 Hz mono frame without checksum."""
    four = bytes([0xFF, 0xFB, 1 << 4 | padding << 1, 0xC0])
    return (four + bytes(17) + body).ljust(mpeg.header(four).size, b"\0")


def test_headers():
    h = mpeg.header(bytes([0xFF, 0xFB, 0x90, 0x00]))  # MPEG-1 Layer III, 128 kbit/s, 44100 Hz
    assert (h.size, h.samples, h.rate, h.side, h.protected) == (417, 1152, 44100, 32, False)
    assert mpeg.header(bytes([0xFF, 0xFB, 0x92, 0x00])).size == 418
    assert (mpeg.header(bytes([0xFF, 0xF3, 0x80, 0xC0])).samples, mpeg.header(bytes([0xFF, 0xF3, 0x80, 0xC0])).rate) == (576, 22050)
    assert mpeg.header(bytes([0xFF, 0xFF, 0x10, 0x00])).samples == 384
    for bad in (b"", b"\xff\xfb", b"\xfe\xfb\x90\0", b"\xff\xfb\xf0\0", b"\xff\xfb\0\0", b"\xff\xfb\x9c\0", b"\xff\xeb\x90\0", b"\xff\xf9\x90\0"):
        assert mpeg.header(bad) is None


def test_resynchronises_after_junk_and_damage():
    good = b"".join(frame(bytes([k])) for k in range(5))
    size = len(frame())
    s = mpeg.probe(b"junk\xff\xfb!" + good[: 2 * size] + b"\xff\xff\0 more junk" + good[2 * size :] + frame()[:30])
    assert len(s.offsets) == 5 and s.samples == 5 * 1152 and s.resyncs == 2 and s.junk == 7 + 13 + 30
    assert s.offsets[0] == 7 and s.offsets[2] == 7 + 2 * size + 13
    stored = bytearray(mpeg.media(mpeg.padded(b"payload " * 300)))
    at = mpeg.probe(bytes(stored)).offsets[1]
    stored[at + 8] ^= 1  # in the side information
    assert mpeg.probe(bytes(stored)).damaged == 1
    with pytest.raises(ValueError):
        mpeg.payload(bytes(stored))


def test_other_streams():
    assert mpeg.probe(b"").offsets == mpeg.probe(b"no audio at all").offsets == []
    vbri = bytearray(frame())
    vbri[36:40], vbri[46:50], vbri[50:54] = b"VBRI", (1000).to_bytes(4, "big"), (3).to_bytes(4, "big")
    s = mpeg.probe(bytes(vbri) + frame() * 3)
    assert (s.table, s.table_bytes, s.table_frames, len(s.offsets)) == ("VBRI", 1000, 3, 3)
    body = b"\3Title"
    tag = b"ID3\4\0\0" + bytes([0, 0, 0, 10 + len(body)]) + b"TIT2" + bytes([0, 0, 0, len(body)]) + b"\0\0" + body
    assert mpeg.probe(tag + frame() * 2).tags == {"TIT2": "Title"}
    assert mpeg.probe(frame() * 2 + b"TAG" + b"Old title".ljust(125, b"\0")).tags == {"TIT2": "Old title"}


def test_query(spark):
    texts = ["Hello", None, "", "é" * 500, "x" * 64, "\xff\xfb\x90 looks like a frame" * 40, "long text " * 100_000, "Hello"]
    data = [(i, t, "m", 1) for i, t in enumerate(texts)] + [(None, "no id", "m", 1), (0, "Hello", "m", 1)]
    got = mpeg.op3(spark.createDataFrame(data, DOCS)).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got}
    for i, t, _, _ in data:
        raw, r = (t or "").encode(), by_id[i]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = mpeg.media(payload)
        assert (r.media_bytes, r.media_sha256, r.duration_samples) == (len(stored), hashlib.sha256(stored).hexdigest(), 1152 * len(r.seek_offsets))
    assert by_id[0][1:] == by_id[7][1:]
    assert mpeg.op3(spark.createDataFrame([], DOCS)).collect() == []


def bitwise_crc(bits):
    value = 0xFFFF
    for bit in bits:
        top = (value >> 15) ^ bit
        value = (value << 1) & 0xFFFF
        if top:
            value ^= 0x8005
    return value


def bits_of(data):
    return [b >> k & 1 for b in data for k in range(7, -1, -1)]


def protected(second, third, fourth, runs, bound, allocations, scale_bits):
    """A protected frame of Layer I or II whose checksum is made bit by bit; runs: (subbands, width)."""
    channels, body, used = 1 if fourth >> 6 == 3 else 2, [], 0
    band = 0
    for n, width in runs:
        for _ in range(n):
            for _ in range(channels if band < bound else 1):
                value = next(allocations) % (1 << width)
                body += [value >> k & 1 for k in range(width - 1, -1, -1)]
                used += (1 if band < bound or channels == 1 else 2) * (value > 0)
            band += 1
    body += [next(allocations) & 1 for _ in range(scale_bits * used)]
    four = bytes([0xFF, second, third, fourth])
    check = bitwise_crc(bits_of(four[2:]) + body)
    packed = bytes(sum(b << (7 - k) for k, b in enumerate(body[i : i + 8])) for i in range(0, len(body), 8))
    return (four + check.to_bytes(2, "big") + packed).ljust(mpeg.header(four).size, b"\x55")


@pytest.mark.parametrize(
    ("second", "third", "fourth", "runs", "bound", "scale_bits"),
    [
        (0xFE, 0x50, 0x00, [(32, 4)], 32, 0),  # Layer I, stereo
        (0xFE, 0x50, 0x50, [(32, 4)], 8, 0),  # Layer I, joint stereo from subband 8 on
        (0xFC, 0x80, 0x00, [(11, 4), (12, 3), (4, 2)], 32, 2),  # Layer II, 128 kbit/s, 44.1 kHz, stereo: 64 a channel
        (0xFC, 0xE0, 0x60, [(11, 4), (12, 3), (7, 2)], 12, 2),  # 384 kbit/s, joint stereo from subband 12 on
        (0xFC, 0xE4, 0x00, [(11, 4), (12, 3), (4, 2)], 32, 2),  # 384 kbit/s at 48 kHz
        (0xFC, 0x20, 0xC0, [(2, 4), (6, 3)], 32, 2),  # 48 kbit/s, mono
        (0xFC, 0x28, 0xC0, [(2, 4), (10, 3)], 32, 2),  # the same at 32 kHz
        (0xF4, 0x80, 0x00, [(4, 4), (7, 3), (19, 2)], 32, 2),  # MPEG-2 Layer II
    ],
)
def test_checksums_of_the_other_layers(second, third, fourth, runs, bound, scale_bits):
    r = random.Random(third)
    one = lambda: protected(second, third, fourth, runs, bound, iter(lambda: r.choice([0, 0, r.randrange(16)]), None), scale_bits)
    frames = [one() for _ in range(4)]
    s = mpeg.probe(b"".join(frames))
    assert (len(s.offsets), s.checked, s.damaged) == (4, 4, 0)
    spoilt = bytearray(frames[2])
    spoilt[6] ^= 0x10
    s = mpeg.probe(frames[0] + frames[1] + bytes(spoilt) + frames[3])
    assert (len(s.offsets), s.checked, s.damaged) == (4, 3, 1)


def test_stray_header_in_front():
    """Bytes that look like a header aren't one unless another frame follows."""
    stray = bytes([0xFF, 0xFB, 0x94, 0xC0]) + b"\1" * 60  # another sample rate, so another kind of stream
    good = b"".join(frame(bytes([k])) for k in range(10))
    s = mpeg.probe(stray + good)
    assert len(s.offsets) == 10 and s.offsets[0] == 64 and s.junk == 64 and s.resyncs == 1


def test_tables_that_lie():
    stored = mpeg.media(mpeg.padded(b"payload " * 3000))
    s = mpeg.probe(stored)
    assert s.lies == [] and len(s.seek) == 100 and s.table_frames == len(s.offsets) and s.duration == s.samples
    at = stored.index(b"Xing")
    for offset, value, name in ((8, b"\0\0\0\1", "frames"), (12, b"\0\0\1\0", "bytes"), (16 + 50, b"\0", "seek")):
        bad = bytearray(stored)
        bad[at + offset : at + offset + len(value)] = value
        assert name in mpeg.probe(bytes(bad)).lies
        with pytest.raises(ValueError):
            mpeg.payload(bytes(bad))
    short = stored[:-128]  # without the tag, and then without the last frame
    assert mpeg.probe(short).lies == [] and mpeg.probe(short[: s.offsets[-1]]).lies[:2] == ["frames", "bytes"]


def test_vbri_points_and_encoder_delay():
    vbri = bytearray(frame())
    size = len(frame())
    vbri[36:40], vbri[46:50], vbri[50:54] = b"VBRI", (5 * size).to_bytes(4, "big"), (4).to_bytes(4, "big")
    vbri[54:62] = (4).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big")
    vbri[62:70] = size.to_bytes(2, "big") * 4
    s = mpeg.probe(bytes(vbri) + frame() * 4)
    assert s.seek == [size * k for k in range(1, 5)] == s.offsets and s.lies == []
    info = bytearray(frame(padding=0).ljust(size, b"\0"))
    first = bytes([0xFF, 0xFB, 0x50, 0xC0])
    info = bytearray((first + bytes(17) + b"Info" + bytes(4) + b"LAME3.100").ljust(mpeg.header(first).size, b"\0"))
    info[4 + 17 + 8 + 21 : 4 + 17 + 8 + 24] = (576 << 12 | 1000).to_bytes(3, "big")
    s = mpeg.probe(bytes(info) + bytes(mpeg_frame(0x50) * 3))
    assert (s.table, s.delay, s.padding, s.duration) == ("Info", 576, 1000, 3 * 1152 - 1576)


def mpeg_frame(third):
    four = bytes([0xFF, 0xFB, third, 0xC0])
    return four.ljust(mpeg.header(four).size, b"\0")


def test_tags():
    audio = frame() * 2
    old = b"\0Old"
    tag = b"ID3\2\0\0" + bytes([0, 0, 0, 6 + len(old)]) + b"TT2" + len(old).to_bytes(3, "big") + old
    assert mpeg.probe(tag + audio).tags == {"TT2": "Old"}
    body = b"\0A\xffB"
    item = b"TIT2" + len(body).to_bytes(4, "big") + b"\0\0" + body
    extended = (6).to_bytes(4, "big") + bytes(6)
    spread = (extended + item).replace(b"\xff", b"\xff\0")
    tag = b"ID3\3\0\xc0" + bytes([0, 0, 0, len(spread)]) + spread
    assert mpeg.probe(tag + audio).tags == {"TIT2": "A\xffB"} and mpeg.probe(tag + audio).offsets[0] == len(tag)
    ape = b"APETAGEX" + (2000).to_bytes(4, "little")
    item = (3).to_bytes(4, "little") + bytes(4) + b"Artist\0Nob"
    foot = ape + (32 + len(item)).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    s = mpeg.probe(audio + item + foot + b"TAG" + b"Song".ljust(125, b"\0"))
    assert s.tags == {"Artist": "Nob", "TIT2": "Song"} and len(s.offsets) == 2 and s.junk == 0
