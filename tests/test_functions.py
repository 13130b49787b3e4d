"""Public vectors and properties of hashes, signatures, canonical JSON, times and detection."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediastrata.functions import canonical, codec_facts, detect, ed25519, hashing, perceptual, timecode
from mediastrata.sources import bitstream


def _input(n: int) -> bytes:
    return bytes(k % 251 for k in range(n))


@pytest.mark.parametrize(
    ("size", "digest"),
    [
        (0, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"),
        (1, "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"),
        (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"),
        (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"),
        (31744, "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47"),
    ],
)
def test_blake3_vectors(size, digest):
    assert hashing.blake3(_input(size)).hex() == digest


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=1024))
def test_blake3_short_and_long_forms_agree(data):
    """A message is hashed by either form to the same chunk value: that of the vectorized form, over the chunk padded into a longer one."""
    value = np.tile(hashing._IV, (1, 1))
    last = max(0, len(data) - 1) // 64
    for k in range(last + 1):
        block = np.frombuffer(data[64 * k : 64 * k + 64].ljust(64, b"\0"), dtype="<u4").astype(np.uint32)[None]
        flags = (1 if k == 0 else 0) | (2 | 8 if k == last else 0)
        value = hashing._compress(value, block, np.zeros(1, np.uint64), np.array([len(data[64 * k : 64 * k + 64])], np.uint32), np.array([flags], np.uint32))
    assert value[0].astype("<u4").tobytes() == hashing.blake3(data)


def test_blake3_of_many():
    sizes = [0, 1, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 5000, 31744]
    assert hashing.blake3_many([_input(n) for n in sizes]) == [hashing.blake3(_input(n)) for n in sizes]
    assert hashing.blake3_many([]) == []


def test_ed25519_vectors():
    """RFC 8032, section 7.1, tests 1 and 2."""
    one = ed25519.SigningKey(bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60"))
    assert one.public_key().hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert one.sign(b"").hex().startswith("e5564300c360ac729086e2cc806e828a")
    two = ed25519.SigningKey(bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb"))
    assert two.public_key().hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    signature = two.sign(b"\x72")
    assert ed25519.verify(two.public_key(), b"\x72", signature)
    assert not ed25519.verify(one.public_key(), b"\x72", signature)
    assert not ed25519.verify(two.public_key(), b"\x73", signature)
    assert not ed25519.verify(two.public_key(), b"\x72", signature[:63])
    assert "9d61" not in repr(one)
    with pytest.raises(ValueError, match="Invalid key size"):
        ed25519.SigningKey(b"short")


def test_hash_and_verify_columns(spark):
    key = ed25519.SigningKey(bytes(range(32)))
    rows = [(b"media", key.public_key().hex(), key.sign(b"media").hex()), (b"other", key.public_key().hex(), key.sign(b"media").hex()), (None, None, None)]
    df = spark.createDataFrame(rows, "data binary, k string, s string")
    got = df.select(hashing.hex_column(hashing.hash_column(F.col("data"), "blake3")), hashing.hex_column(hashing.hash_column(F.col("data"))), ed25519.verify_column(F.col("k"), F.col("data"), F.col("s"))).collect()
    assert got[0][0] == hashing.blake3(b"media").hex()
    assert [r[2] for r in got] == [True, False, False]
    assert got[2][0] is None and got[2][1] is None
    with pytest.raises(ValueError, match="unknown hash"):
        hashing.hash_column(F.col("data"), "md5")


def test_canonical_json():
    loose = {"signatures": [{"public_key": "k", "signature": "s", "extra": 1}], "content": {"title": "Ünï", "type": "Original", "work_id": "w", "authors": [], "created_at": "t", "tracks": [{"track_id": 0, "codec": "raw", "merkle_root": "", "total_chunks": 0, "chunk_size": 1}]}}
    text = canonical.to_bytes(canonical.canonical("manifest", loose)).decode()
    assert text.startswith('{"content":{"type":"Original","work_id":"w","title":"Ünï","authors":[],"authorship_fingerprint":null')
    assert '"perceptual_hash":null' in text and '"chunk_index":[]' in text
    assert text.endswith('"signatures":[{"signature":"s","public_key":"k"}]}')
    assert canonical.to_bytes(canonical.canonical("manifest", json.loads(text))).decode() == text
    with pytest.raises(canonical.MalformedManifest):
        canonical.canonical("manifest", {"content": {"type": "Other"}, "signatures": []})


def test_times(spark):
    df = spark.createDataFrame([(90, 1, 30, 2.5), (90, 0, 30, 2.5), (None, 1, 30, -1.0), (7, None, 30, math.nan), (7, 1001, 30000, math.inf)], "pts long, num int, den int, t double")
    got = df.select(timecode.pts_to_seconds(F.col("pts"), F.col("num"), F.col("den")), timecode.seconds_to_pts_floor(F.col("t"), F.col("num"), F.col("den")), timecode.seconds_to_pts_ceil(F.col("t"), F.col("num"), F.col("den"))).collect()
    assert [tuple(r) for r in got] == [(3.0, 75, 75), (None, None, None), (None, None, None), (None, None, None), (7 * 1001.0 / 30000, None, None)]
    big = spark.range(1).select(timecode.samples_to_us(F.lit(2**62), F.lit(1)), timecode.samples_to_us(F.lit(5), F.lit(0)), timecode.samples_to_us(F.lit(1024), F.lit(44100))).first()
    assert tuple(big) == (2**63 - 1, 0, 23219)


PREFIXES = {
    b"\x89PNG\r\n\x1a\n": ("png", None), b"\xff\xd8\xff": ("jpg", None), b"GIF89a": ("gif", None), b"RIFF\0\0\0\0WEBP": ("webp", None), b"RIFF\0\0\0\0WAVE": (None, None),
    b"\0\0\0\x18ftypheic\0\0\0\0heic": ("heic", "mp4"), b"\0\0\0\x18ftypisom\0\0\0\0mif1xxxx": ("heic", "mp4"), b"\0\0\0\x14ftypisom\0\0\0\0mif1": (None, "mp4"), b"\0\0\0\x18ftypisom\0\0\0\0isomiso2": (None, "mp4"),
    b"\x1aE\xdf\xa3....WebM": (None, "webm"), b"\x1aE\xdf\xa3....": (None, "mkv"), b"": (None, None), b"\0": (None, None), b"\0\0\0\x0cmoovxxxx": (None, "mp4"), b"\0\0\0\x10abcd12345678\0\0\0\x08moov": (None, "mp4"),
}


def test_detection(spark):
    rows = [(k, bytearray(b)) for k, b in enumerate(PREFIXES)]
    got = spark.createDataFrame(rows, "k int, data binary").select("k", detect.image_type(F.col("data")), detect.container_type(F.col("data")), detect.is_isobmff(F.col("data"))).orderBy("k").collect()
    for row, (data, (image, container)) in zip(got, PREFIXES.items(), strict=True):
        if data[4:8] == b"ftyp" and data[3:4] == b"\x14":
            image = "heic"  # the box ends at 20 bytes: its one listed brand counts
        assert (row[1], row[2]) == (image, container), data
        assert row[3] == bitstream.is_isobmff(data)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_emulation_strip(data):
    out, k = bytearray(), 0
    while k < len(data):
        if data[k : k + 3] == b"\0\0\3":
            out += b"\0\0"
            k += 3
        else:
            out.append(data[k])
            k += 1
    assert bitstream.without_emulation(data) == bytes(out)


def test_perceptual_hash():
    assert perceptual.perceptual_hash(b"x" * 63) is None
    assert perceptual.perceptual_hash(bytes(range(256))) == perceptual.perceptual_hash(bytes(range(256)))
    assert perceptual.perceptual_hash(bytes(range(256))) != perceptual.perceptual_hash(bytes(range(255, -1, -1)))


def test_opus_pages_agree(spark):
    granules = [None, 960, 1920, None, 1000, 5000]
    row = spark.createDataFrame([(granules,)], "g array<long>").select(codec_facts.pages_timing(F.col("g")).alias("t")).first()
    got = [(x["pts_us"], x["duration_us"]) for x in row["t"]]
    assert got == [(0, 0), (0, 0), (0, 20000), (20000, 0), (20000, 0), (20000, 83333)]
