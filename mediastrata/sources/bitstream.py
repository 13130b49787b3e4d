"""Elementary streams: byte strings to frames.

Each parser turns a whole stream into frames (start, length, pts, duration, is_idr) and the track's facts, or None when the bytes
aren't such a stream. They run inside Arrow functions (see media.py), a file at a time.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

MICROS = 1_000_000
_INT64 = 2**63 - 1

# Rates by index, and profiles whose parameter sets have the longer form.
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
FLAC_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
HIGH_PROFILES = frozenset((100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134))
OPUS_RATE = 48_000
VOTING_NALS = 10


@dataclass
class Frame:
    start: int
    length: int
    pts: int | None
    duration: int = 0
    is_idr: bool = False


@dataclass
class Stream:
    codec: str
    frames: list[Frame] = field(default_factory=list)
    extradata: bytes | None = None
    width: int | None = None
    height: int | None = None
    sample_rate: int | None = None
    channels: int | None = None
    timebase: tuple[int, int] | None = None


class _Invalid(Exception):
    pass


def micros(samples: int, rate: int) -> int:
    return min(samples * MICROS // rate, _INT64) if rate else 0


def aac_config(object_type: int, rate_index: int, channels: int) -> bytes:
    """The two-byte AudioSpecificConfig."""
    return struct.pack(">H", (object_type & 31) << 11 | (rate_index & 15) << 7 | (channels & 15) << 3)


def adts(data: bytes) -> Stream | None:
    """AAC in ADTS frames that fill the data exactly and agree on rate, channels and object type."""
    frames, at, pts, kind = [], 0, 0, None
    while len(data) - at >= 7:
        head = int.from_bytes(data[at : at + 7], "big")
        length, rate_index = head >> 13 & 0x1FFF, head >> 34 & 15
        this = (rate_index, head >> 30 & 7, (head >> 38 & 3) + 1)
        header = 7 if head >> 40 & 1 else 9
        if head >> 44 != 0xFFF or rate_index >= len(ADTS_RATES) or (kind or this) != this or not header <= length <= len(data) - at:
            return None
        step = MICROS * 1024 // ADTS_RATES[rate_index]
        frames.append(Frame(at, length, pts, step))
        at, pts, kind = at + length, pts + step, this
    if kind is None or at != len(data):
        return None
    rate_index, channels, object_type = kind
    return Stream("aac", frames, aac_config(object_type, rate_index, channels), sample_rate=ADTS_RATES[rate_index], channels=channels or None, timebase=(1, MICROS))


def ogg_pages(data: bytes) -> list[tuple[int, int, int | None]] | None:
    """(start, length, granule) of pages that fill the data exactly."""
    out, at = [], 0
    while len(data) - at >= 27:
        segments = data[at + 26]
        end = at + 27 + segments + sum(data[at + 27 : at + 27 + segments])
        if data[at : at + 4] != b"OggS" or at + 27 + segments > len(data) or end > len(data):
            return None
        (granule,) = struct.unpack_from("<Q", data, at + 6)
        out.append((at, end - at, None if granule == 2**64 - 1 else granule))
        at = end
    return out if out and at == len(data) else None


def opus_head(data: bytes) -> tuple[int, int] | None:
    """(rate, channels) of the first identification header anywhere."""
    at = data.find(b"OpusHead")
    return None if at < 0 or at + 19 > len(data) else (struct.unpack_from("<I", data, at + 12)[0], data[at + 9])


def ogg_opus(data: bytes) -> Stream | None:
    """Opus in Ogg; a page lasts as long as its granule position is beyond the last one known."""
    pages = ogg_pages(data)
    if pages is None:
        return None
    rate, channels = opus_head(data) or (OPUS_RATE, 0)
    frames, before, samples = [], None, 0
    for start, length, granule in pages:
        lasts = max(0, granule - before) if granule is not None and before is not None else 0
        frames.append(Frame(start, length, micros(samples, OPUS_RATE), micros(lasts, OPUS_RATE)))
        before, samples = before if granule is None else granule, samples + lasts
    return Stream("opus", frames, sample_rate=rate or OPUS_RATE, channels=channels or None, timebase=(1, MICROS))


def _crc8_table() -> list[int]:
    """For the polynomial x^8 + x^2 + x + 1."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte << 1 ^ (0x107 if byte & 0x80 else 0)
        out.append(byte)
    return out


_CRC8 = _crc8_table()


def crc8(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc = _CRC8[crc ^ byte]
    return crc


def flac_info(data: bytes) -> tuple[int, int, int] | None:
    """(end of the metadata, rate, channels)."""
    if data[:4] != b"fLaC":
        return None
    at, found = 4, None
    while at + 4 <= len(data):
        kind, length = data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        last, body = data[at] > 127, at + 4
        at = body + length
        if at > len(data):
            return None
        if kind == 0 and length >= 34:
            bits = int.from_bytes(data[body + 10 : body + 18], "big")
            found = (bits >> 44 & 0xFFFFF, (bits >> 41 & 7) + 1)
        if last:
            return None if found is None else (at, *found)
    return None


def coded_number_length(data: bytes, at: int) -> int | None:
    """Bytes of a UTF-8-like number: one, or as many as its first byte has leading ones, 2 to 7."""
    if at >= len(data):
        return None
    ones = 8 - (data[at] ^ 0xFF).bit_length()
    if ones == 0:
        return 1
    rest = data[at + 1 : at + ones]
    return ones if 2 <= ones <= 7 and len(rest) == ones - 1 and all(b >> 6 == 2 for b in rest) else None


def flac_frame(data: bytes, at: int, rate: int) -> tuple[int, int | None] | None:
    """(samples, rate) of the frame header at a byte, whose checksum must hold; rate is None for the reserved code."""
    if len(data) - at < 4 or data[at] != 0xFF or data[at + 1] not in (0xF8, 0xF9) or data[at + 3] & 1:
        return None
    block, sampling = divmod(data[at + 2], 16)
    number = coded_number_length(data, at + 4)
    if number is None or block == 0:
        return None
    end = at + 4 + number

    def take(n: int) -> int:
        nonlocal end
        if end + n > len(data):
            raise _Invalid
        end += n
        return int.from_bytes(data[end - n : end], "big")

    try:
        samples = 192 if block == 1 else take(block - 5) + 1 if block in (6, 7) else 144 << block if block < 6 else 1 << block
        try:
            found = rate if sampling == 0 else FLAC_RATES.get(sampling) or (take(1) * 1000 if sampling == 12 else take(2) if sampling == 13 else take(2) * 10 if sampling == 14 else None)
        except _Invalid:
            found = None
    except _Invalid:
        return None
    return (samples, found) if end < len(data) and data[end] == crc8(data[at:end]) else None


_FLAC_SYNC = re.compile(rb"\xff[\xf8\xf9]")


def flac(data: bytes) -> Stream | None:
    """FLAC: the metadata is the first frame, of no duration; each frame runs to the next header that holds."""
    info = flac_info(data)
    if info is None:
        return None
    end, rate, channels = info
    heads: list[tuple[int, int, int | None]] = []
    at = end
    while m := _FLAC_SYNC.search(data, at):
        head = flac_frame(data, m.start(), rate)
        if head:
            heads.append((m.start(), *head))
        at = m.start() + (2 if head else 1)
    if not heads:
        return None
    frames, samples = [Frame(0, end, 0)], 0
    for (start, size, own), stop in zip(heads, [*(h[0] for h in heads[1:]), len(data)], strict=True):
        used = rate if own is None else own
        frames.append(Frame(start, stop - start, micros(samples, used), micros(size, used)))
        samples += size
    return Stream("flac", frames, sample_rate=rate, channels=channels, timebase=(1, MICROS))


class Bits:
    """A bit reader, most significant first; reading past the end raises."""

    def __init__(self, data: bytes):
        self._value, self._left = int.from_bytes(data, "big"), 8 * len(data)

    def u(self, n: int) -> int:
        if n > self._left:
            raise _Invalid
        self._left -= n
        return self._value >> self._left & (1 << n) - 1

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
        if zeros > 32:
            raise _Invalid
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        n = self.ue()
        return (n + 1) // 2 if n % 2 else -(n // 2)

    def skip_scaling_list(self, size: int) -> None:
        scale = 8
        for _ in range(size):
            following = (scale + self.se()) % 256
            if not following:
                return
            scale = following


def without_emulation(data: bytes) -> bytes:
    """00 00 03 to 00 00, left to right."""
    return data.replace(b"\0\0\x03", b"\0\0")


def h264_parameters(sps: bytes) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """(width, height), and the timebase (2 * units per tick, scale), of a sequence parameter set with its NAL header."""
    if len(sps) < 4:
        return None, None
    b, size = Bits(without_emulation(sps[1:])), None
    try:
        profile = b.u(8)
        b.u(16)
        b.ue()
        chroma = 1
        if profile in HIGH_PROFILES:
            chroma = b.ue()
            if chroma == 3:
                b.u(1)
            b.ue()
            b.ue()
            b.u(1)
            if b.u(1):
                for k in range(12 if chroma == 3 else 8):
                    if b.u(1):
                        b.skip_scaling_list(16 if k < 6 else 64)
        b.ue()
        order = b.ue()
        if order == 0:
            b.ue()
        elif order == 1:
            b.u(1)
            b.se()
            b.se()
            for _ in range(b.ue()):
                b.se()
        b.ue()
        b.u(1)
        wide, high = b.ue() + 1, b.ue() + 1
        fields = 2 - b.u(1)
        if fields == 2:
            b.u(1)
        b.u(1)
        left, right, top, bottom = (b.ue(), b.ue(), b.ue(), b.ue()) if b.u(1) else (0, 0, 0, 0)
        across, down = (1, fields) if chroma in (0, 3) else (2, 2 * fields)
        size = max(0, 16 * wide - (left + right) * across), max(0, 16 * high * fields - (top + bottom) * down)
        if not b.u(1):
            return size, None
        if b.u(1) and b.u(8) == 255:
            b.u(32)
        if b.u(1):
            b.u(1)
        if b.u(1):
            b.u(4)
            if b.u(1):
                b.u(24)
        if b.u(1):
            b.ue()
            b.ue()
        if not b.u(1):
            return size, None
        units, scale = b.u(32), b.u(32)
        b.u(1)
        return size, (min(2 * units, 2**32 - 1), scale) if units and scale else None
    except _Invalid:
        return size, None


def annexb_extradata(*units: bytes | None) -> bytes:
    return b"".join(b"\0\0\0\1" + u for u in units if u)


def avcc_extradata(sps: bytes, pps: bytes) -> bytes:
    """An AVC configuration record with one parameter set of each kind."""
    profile = (sps + b"\0\0\0\0")[1:4] if len(sps) < 4 else sps[1:4]
    return b"\1" + profile + b"\xff\xe1" + struct.pack(">H", len(sps) & 0xFFFF) + sps + b"\1" + struct.pack(">H", len(pps) & 0xFFFF) + pps


# NAL types that speak for a codec, that are random access points, and that hold picture slices.
_VOTES = {"h264": {1, 5, 7, 8}, "h265": {1, 19, 20, 32, 33, 34}}
_IDR = {"h264": {5}, "h265": {19, 20}}
_SLICES = {"h264": range(1, 6), "h265": range(0, 32)}
_START_CODE = re.compile(rb"\x00?\x00\x00\x01")
_BOXES = frozenset((b"ftyp", b"moov", b"moof", b"mdat", b"free", b"skip", b"wide", b"uuid", b"jumb", b"meta"))
_LATER_BOXES = _BOXES - {b"free", b"skip", b"wide", b"uuid"}


def is_isobmff(data: bytes) -> bool:
    """The same rule as functions.detect.is_isobmff, on one value."""
    kind = data[4:8]
    if len(data) < 12 or not (kind.isalnum() and kind.isascii()):
        return False
    at, end = 0, min(len(data), 4096)
    found = kind in _BOXES
    while not found and at + 8 <= end:
        found = data[at + 4 : at + 8] in _LATER_BOXES
        size = int.from_bytes(data[at : at + 4], "big")
        if not 8 <= size <= end - at:
            break
        at += size
    return found


def nal_type(codec: str, first: int) -> int:
    return first & 31 if codec == "h264" else first >> 1 & 63


def _starts(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, first byte after the code) of the start codes; a fourth zero before belongs to the code."""
    for m in _START_CODE.finditer(data):
        yield m.start(), m.end()


def annexb(data: bytes) -> Stream | None:
    """H.264 or H.265 with start codes, two at least; a unit's pts is the number of slices before it."""
    if is_isobmff(data):
        return None
    codes = list(_starts(data))
    if len(codes) < 2:
        return None
    firsts = [data[at] for _, at in codes[:VOTING_NALS] if at < len(data)]
    votes = {c: sum(nal_type(c, f) in kinds for f in firsts) for c, kinds in _VOTES.items()}
    codec = "h265" if votes["h265"] > votes["h264"] else "h264"
    frames, sets, slices = [], {}, 0
    for (start, body), end in zip(codes, [*(c[0] for c in codes[1:]), len(data)], strict=True):
        if body >= end:
            continue
        kind = nal_type(codec, data[body])
        frames.append(Frame(start, end - start, slices, is_idr=kind in _IDR[codec]))
        slices += kind in _SLICES[codec]
        sets.setdefault(kind, data[body:end])
    if not frames:
        return None
    out = Stream(codec, frames)
    if codec == "h265":
        out.extradata = annexb_extradata(sets.get(32), sets.get(33), sets.get(34)) or None
    elif 7 in sets and 8 in sets:
        out.extradata = annexb_extradata(sets[7], sets[8])
        size, out.timebase = h264_parameters(sets[7])
        out.width, out.height = (x or None for x in size or (0, 0))
    return out


def holds_idr(data: bytes) -> bool:
    """Whether a chunk of a video track is a stream by itself, of two start codes at least, that holds a random access point."""
    stream = annexb(data)
    return stream is not None and any(f.is_idr for f in stream.frames)


def by_codec(data: bytes, codec: str) -> Stream | None:
    """The stream of a demuxed track: parsed, else only named; None for codecs that aren't supported."""
    codec = codec.lower()
    if codec in ("opus", "flac"):
        return (ogg_opus if codec == "opus" else flac)(data) or Stream(codec)
    return elementary(data) or (Stream(codec) if codec in ("aac", "h264", "h265", "hevc") else None)


def elementary(data: bytes) -> Stream | None:
    return adts(data) or annexb(data)
