"""Parsers of elementary streams, and chunking."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediastrata.operators import chunking
from mediastrata.sources import bitstream, media
from tests import media_samples as make


def test_adts():
    s = bitstream.adts(make.adts(3))
    assert (s.codec, s.sample_rate, s.channels, s.timebase, len(s.frames)) == ("aac", 44100, 2, (1, 1_000_000), 3)
    assert [f.pts for f in s.frames] == [0, 23219, 46438]
    assert s.extradata.hex() == "1210"
    assert bitstream.adts(make.adts(3, crc=True)) is not None
    assert bitstream.adts(make.adts(2) + make.adts(1, rate_index=3)) is None
    assert bitstream.adts(make.adts(2) + b"abc") is None
    assert bitstream.adts(make.adts(1, rate_index=13)) is None
    assert bitstream.adts(b"") is None and bitstream.adts(b"\xff\xf1") is None


def test_ogg_opus():
    s = bitstream.ogg_opus(make.ogg([0, None, 48000, 96000]))
    assert (s.sample_rate, s.channels) == (44100, 2)
    assert [(f.pts, f.duration) for f in s.frames] == [(0, 0), (0, 0), (0, 1_000_000), (1_000_000, 1_000_000)]
    assert bitstream.ogg_opus(make.ogg([0, 960], head=False)).sample_rate == 48000
    assert bitstream.ogg_opus(make.ogg([0]) + b"x") is None
    assert sum(f.length for f in s.frames) == len(make.ogg([0, None, 48000, 96000]))


def test_flac():
    data = make.flac(3)
    s = bitstream.flac(data)
    assert (s.sample_rate, s.channels, len(s.frames)) == (44100, 2, 4)
    assert (s.frames[0].length, s.frames[0].duration) == (42, 0)
    assert [f.pts for f in s.frames[1:]] == [0, 92879, 185759]
    assert sum(f.length for f in s.frames) == len(data)
    assert len(bitstream.flac(make.flac(3, bad=1)).frames) == 3
    gapped = bitstream.flac(make.flac(2, gap=b"zzz"))
    assert sum(f.length for f in gapped.frames) == len(make.flac(2, gap=b"zzz")) - 3
    assert bitstream.flac(make.flac(0)) is None and bitstream.flac(b"fLaC") is None


def test_h264():
    s = bitstream.annexb(make.h264())
    assert (s.codec, s.width, s.height, s.timebase) == ("h264", 1920, 1080, (2002, 60000))
    assert [f.is_idr for f in s.frames] == [False, False, True, False, False, True, False]
    assert [f.pts for f in s.frames] == [0, 0, 0, 1, 2, 3, 4]
    assert s.extradata.startswith(b"\0\0\0\1\x67")
    high = bitstream.h264_parameters(make.sps(40, 30, None, None, profile=100))
    assert high == ((640, 480), None)
    assert bitstream.h264_parameters(b"\x67\1\2") == (None, None)
    assert bitstream.h264_parameters(make.sps()[:6]) == (None, None)
    assert bitstream.annexb(b"\0\0\1\x67") is None
    assert bitstream.annexb(b"junk" + make.h264()).frames[0].start == 4


def test_h265():
    s = bitstream.annexb(make.h265())
    assert (s.codec, len(s.frames), [f.is_idr for f in s.frames]) == ("h265", 3, [False, False, True])
    assert s.width is None and s.extradata.count(b"\0\0\0\1") == 2


def test_idr_of_chunks(spark):
    rows = [(bytearray(make.h264()), "h264"), (bytearray(make.h265()), "hevc"), (bytearray(make.h264()[:20]), "h264"), (bytearray(b"\0\0\1"), "h264"), (None, "h264"), (bytearray(make.h264()), "aac")]
    df = spark.createDataFrame(rows, "data binary, codec string")
    assert [r[0] for r in df.select(media.idr_column(F.col("data"), F.col("codec"))).collect()] == [True, True, False, False, False, False]


def test_bit_reader():
    b = bitstream.Bits(make.Writer().ue(0).ue(1).ue(2).ue(7).ue(3).ue(4).bytes())
    assert [b.ue() for _ in range(4)] == [0, 1, 2, 7]
    assert (b.se(), b.se()) == (2, -2)


def test_avcc():
    assert bitstream.avcc_extradata(b"\x67\x42\x00\x28", b"\x68").hex() == "01420028ffe1000467420028" + "01000168"
    assert bitstream.avcc_extradata(b"", b"")[:6] == b"\1\0\0\0\xff\xe1"


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300))
def test_parsers_survive_anything(data):
    for parse in (bitstream.adts, bitstream.annexb, bitstream.ogg_opus, bitstream.flac):
        parse(data)
    bitstream.flac(b"fLaC" + data)
    bitstream.annexb(b"\0\0\0\1\x67" + data + b"\0\0\1\x68\1")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 10_000), st.integers(-5, 3000), st.booleans()), max_size=40), st.integers(1, 120))
def test_groups_cover_frames(frames, cap):
    runs = list(chunking.group_frames(frames, cap, 5000, True))
    assert [first for first, *_ in runs] == [sum(n for _, _, n, _ in runs[:k]) for k in range(len(runs))]
    assert sum(n for _, _, n, _ in runs) == len(frames)
    for first, pts, n, size in runs:
        assert size == sum(f[0] for f in frames[first : first + n]) and pts == frames[first][1]
        assert size <= cap or n == 1
        assert not any(f[3] for f in frames[first + 1 : first + n])


def test_chunk_tracks(spark):
    rows = [("a", bytearray(make.adts(120))), ("v", bytearray(make.h264())), ("r", bytearray(b"x" * 1000)), ("e", bytearray(b"")), ("p", bytearray(b"\x89PNG\r\n\x1a\n" + b"0" * 100)), ("n", None)]
    files = spark.createDataFrame(rows, "name string, data binary")
    got = media.chunk_tracks(files, ["name"], cap=400).orderBy("name", "chunk_index").collect()
    by = {n: [r for r in got if r["name"] == n] for n in "avrepn"}
    for name, data in rows:
        assert b"".join(bytes(r["data"]) for r in by[name]) == bytes(data or b"")
    assert {r["codec"] for r in by["a"]} == {"aac"} and {r["codec"] for r in by["v"]} == {"h264"} and {r["codec"] for r in by["r"]} == {"raw"}
    assert [r["is_idr"] for r in by["v"]] == [False, True, True]
    assert by["p"][0]["container_type"] == "png" and len(by["r"]) == 3
    longest = media.chunk_tracks(files.where("name = 'a'"), ["name"]).collect()
    assert [r["pts"] for r in longest] == [0, 998417, 1996834]
    demuxed = spark.createDataFrame([("o", bytearray(make.ogg([0, 48000])), "opus"), ("f", bytearray(b"zz"), "flac"), ("u", bytearray(b"zz"), "vp9")], "name string, data binary, codec string")
    got = {r["name"]: r for r in media.chunk_tracks(demuxed, ["name"], codec_col="codec").collect()}
    assert set(got) == {"o", "f"} and got["f"]["sample_rate"] is None and got["o"]["timebase_den"] == 1_000_000
    with pytest.raises(ValueError, match="1 or more"):
        media.chunk_tracks(files, ["name"], cap=0)


def test_fixed_size(spark):
    rows = [(1, bytearray(b"abcdef")), (2, bytearray(b"abcd")), (3, bytearray(b"")), (4, None), (5, bytearray(b"a"))]
    df = chunking.fixed_size(spark.createDataFrame(rows, "id int, data binary"), F.col("data"), 2, data_col="part")
    got = sorted((r["id"], r["chunk_index"], bytes(r["part"])) for r in df.collect())
    assert got == [(1, 0, b"ab"), (1, 1, b"cd"), (1, 2, b"ef"), (2, 0, b"ab"), (2, 1, b"cd"), (5, 0, b"a")]
    with pytest.raises(ValueError, match="1 or more"):
        chunking.fixed_size(df, F.col("part"), 0)
