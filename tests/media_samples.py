"""Small media streams, built byte by byte."""

from __future__ import annotations

import struct

from mediastrata.sources.bitstream import crc8


def adts(frames: int, rate_index: int = 4, channels: int = 2, crc: bool = False, payload: int = 100) -> bytes:
    out = b""
    header = 9 if crc else 7
    for k in range(frames):
        length = header + payload
        head = 0xFFF << 44 | (0 if crc else 1) << 40 | 1 << 38 | rate_index << 34 | channels << 30 | length << 13
        out += head.to_bytes(7, "big") + b"\0" * (header - 7) + bytes([k % 251]) * payload
    return out


def ogg(granules: list[int | None], head: bool = True) -> bytes:
    out = b""
    for k, g in enumerate(granules):
        body = b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 0, 44100, 0, 0) if head and k == 0 else bytes([k]) * 300
        segments = [255] * (len(body) // 255) + [len(body) % 255]
        out += b"OggS\0\0" + struct.pack("<Q", 2**64 - 1 if g is None else g) + b"\0" * 12 + bytes([len(segments), *segments]) + body
    return out


def flac(frames: int, bad: int | None = None, gap: bytes = b"") -> bytes:
    info = b"\0" * 10 + struct.pack(">Q", 44100 << 44 | 1 << 41 | 15 << 36) + b"\0" * 16
    out = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + gap
    for k in range(frames):
        head = b"\xff\xf8" + bytes([0xC9, 0x18, k])
        check = crc8(head) ^ (1 if k == bad else 0)
        out += head + bytes([check]) + b"\x11" * 40
    return out


class Writer:
    def __init__(self) -> None:
        self.bits = ""

    def u(self, value: int, n: int) -> Writer:
        self.bits += format(value, f"0{n}b")
        return self

    def ue(self, value: int) -> Writer:
        text = format(value + 1, "b")
        self.bits += "0" * (len(text) - 1) + text
        return self

    def bytes(self) -> bytes:
        bits = self.bits + "1"
        bits += "0" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def sps(width_mbs: int = 120, height_units: int = 68, crop: tuple[int, int, int, int] | None = (0, 0, 0, 4), timing: tuple[int, int] | None = (1001, 60000), profile: int = 66) -> bytes:
    w = Writer().u(profile, 8).u(0, 8).u(40, 8).ue(0)
    if profile == 100:
        w.ue(1).ue(0).ue(0).u(0, 1).u(1, 1).u(1, 1)
        w.ue(0)
        for _ in range(15):
            w.ue(0)
        w.u(0, 7)
    w.ue(0).ue(0).ue(0).ue(1).u(0, 1).ue(width_mbs - 1).ue(height_units - 1).u(1, 1).u(1, 1)
    w.u(1 if crop else 0, 1)
    for c in crop or ():
        w.ue(c)
    w.u(1 if timing else 0, 1)
    if timing:
        w.u(0, 1).u(0, 1).u(0, 1).u(0, 1).u(1, 1).u(timing[0], 32).u(timing[1], 32).u(1, 1)
    return b"\x67" + w.bytes().replace(b"\0\0\0", b"\0\0\3\0").replace(b"\0\0\1", b"\0\0\3\1")


def h264(parameter_set: bytes | None = None) -> bytes:
    unit = lambda b: b"\0\0\0\1" + b
    body = bytes(range(4, 60))
    return unit(parameter_set or sps()) + unit(b"\x68\x01\x02") + unit(b"\x65" + body) + b"\0\0\1\x41" + body + unit(b"\x41" + body) + unit(b"\x65" + body) + unit(b"\x41" + body)


def h265() -> bytes:
    return b"".join(b"\0\0\0\1" + head + b"\x01" * 10 for head in (b"\x40\x01", b"\x42\x01", b"\x26\x01"))
