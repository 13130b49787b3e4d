"""External tools, by stand-ins that do what the real ones are asked for; what fails without them; and the container sink's names."""

from __future__ import annotations

import json
import os
import stat

import pytest

from mediastrata.functions.ed25519 import SigningKey
from mediastrata.plans import manifests as m
from mediastrata.plans import works
from mediastrata.sources import container, external, media
from tests import media_samples as make

SIGNERS = m.Signers(SigningKey(bytes(range(32))), SigningKey(bytes(32)))
TTP_KEY = SIGNERS.ttp.public_key().hex()
PROBE = """#!/bin/sh
case "$*" in
*show_streams*) echo '{"streams":[{"index":2,"codec_type":"audio","codec_name":"AAC"},{"index":1,"codec_type":"video","codec_name":"h264"},{"index":0,"codec_type":"subtitle","codec_name":"text"},{"index":3,"codec_type":"video","codec_name":"vp9"}]}' ;;
*) echo '{"format":{"tags":{"Title":"T","SMED.type":"original"}}}' ;;
esac
"""
#: Writes its arguments and inputs, one after the other, to its last argument.
MPEG = """#!/bin/sh
for last; do :; done
case "$*" in
*-map*) for a; do case "$a" in *in.mp4) cat "$a" > "$last" ;; esac; done ;;
*) echo "$*" | sed 's#/[^ ]*/##g' > "$last"; for a; do case "$a" in *.bin) cat "$a" >> "$last" ;; esac; done ;;
esac
"""


@pytest.fixture
def tools(tmp_path, monkeypatch):
    for name, text in (("ffprobe", PROBE), ("ffmpeg", MPEG)):
        path = tmp_path / name
        path.write_text(text)
        path.chmod(path.stat().st_mode | stat.S_IEXEC)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")


def test_streams_are_filtered_and_ordered(tools):
    assert [(i, c) for i, c, _ in external.streams(b"abc", "mp4")] == [(1, "h264"), (2, "aac")]
    assert {d for _, _, d in external.streams(b"abc", "mp4")} == {b"abc"}


def test_mux_names_inputs_rates_and_tags(tools):
    tracks = [{"codec": "h264", "timebase_num": 1001, "timebase_den": 30000, "data": b"VIDEO"}, {"codec": "aac", "timebase_num": 1, "timebase_den": 1_000_000, "data": b"AUDIO"}]
    said, _, rest = external.muxed(tracks, {"smed.type": "original"}, "mp4").partition(b"\n")
    assert rest == b"VIDEOAUDIO"
    assert said.decode().split(" -i ")[0].endswith("-r 30000/1001 -f h264") and b"-f aac -i" in said and said.count(b"-r ") == 1
    assert b"-movflags use_metadata_tags -metadata smed.type=original -c copy" in said
    with pytest.raises(ValueError, match="vp9"):
        external.muxed([{"codec": "vp9", "data": b""}], {}, "mp4")


def test_missing_and_failing_tools(monkeypatch, tmp_path):
    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(external.MissingTool, match="ffprobe"):
        list(external.streams(b"", "mp4"))
    (tmp_path / "ffprobe").write_text("#!/bin/sh\nexit 3\n")
    (tmp_path / "ffprobe").chmod(0o755)
    with pytest.raises(external.ToolFailed, match="status 3"):
        external.run("ffprobe")


def test_demux_without_the_tool_says_so(spark):
    files = spark.createDataFrame([("w", "mp4", bytearray(b"x"))], "work_id string, container_type string, data binary")
    if external.shutil.which("ffprobe"):
        pytest.skip("the tool is installed")
    for df in (external.demux(files, ["work_id"]), external.read_tags(files)):
        with pytest.raises(Exception, match="MissingTool"):
            df.collect()


def test_container_names(spark, tmp_path):
    container.register(spark)
    rows = [("w1", 0, bytearray(make.adts(50))), ("w2", 0, bytearray(make.h264()))]
    signed, chunks = works.sign(spark.createDataFrame(rows, "work_id string, input_ord int, data binary"), SIGNERS, cap=4096)
    write = lambda name, path: works.containers(signed, chunks, name).write.format("provenance").mode("append").save(str(path))
    for name in ("concat('../', work_id)", "concat('a/', work_id)", "'same.smed'", "concat('.', work_id)"):
        with pytest.raises(Exception, match="isn't the name|several works|isn't the name of a file|before its head"):
            write(name, tmp_path / "bad")
        assert not [n for n in os.listdir(tmp_path / "bad")] and not os.path.exists(tmp_path / "w1")
    write("concat(work_id, '.smed')", tmp_path / "good")
    assert sorted(os.listdir(tmp_path / "good")) == ["w1.smed", "w2.smed"]
    read = spark.read.format("provenance").option("table", "chunks")
    assert read.option("track", 0).load(str(tmp_path / "good")).count() == chunks.count()
    assert read.option("track", 1).load(str(tmp_path / "good")).count() == 0
    (tmp_path / "good" / "text").write_bytes(b"not a container")
    with pytest.raises(Exception, match="Invalid magic"):
        spark.read.format("provenance").load(str(tmp_path / "good")).collect()
    tolerant = spark.read.format("provenance").option("mode", "permissive")
    assert tolerant.load(str(tmp_path / "good")).count() == 2
    assert [r["error"][:13] for r in tolerant.option("table", "errors").load(str(tmp_path / "good")).collect()] == ["Invalid magic"]


def test_a_keyframe_chunk_has_two_start_codes(spark):
    idr, slice_ = b"\0\0\0\1\x65idr", b"\0\0\0\1\x41slice"
    sets = b"\0\0\0\1\x67\x42" + b"\0\0\0\1\x68p"
    data = sets + idr + idr + slice_
    files = spark.createDataFrame([("v", bytearray(data))], "name string, data binary")
    got = [(bytes(r["data"]), r["is_idr"]) for r in media.chunk_tracks(files, ["name"]).orderBy("chunk_index").collect()]
    assert got == [(sets, False), (idr, False), (idr + slice_, True)]


def test_details_of_a_clip(spark):
    rows = [("w1", 0, bytearray(make.adts(200)))]
    signed, chunks = works.sign(spark.createDataFrame(rows, "work_id string, input_ord int, data binary"), SIGNERS)
    request = "request_id int, derivative_id string, work_id string, track_id long, start_time double, end_time double, start_chunk long, end_chunk long"
    clips, _, errors = works.clip(signed, chunks, spark.createDataFrame([(1, "d", "w1", 0, None, None, 1, 3)], request), SIGNERS)
    assert errors.count() == 0
    got = {(r["section"], r["ord"]): (r["label"], r["first"], r["stop"]) for r in works.report_details(clips, TTP_KEY).collect()}
    assert got["mapping", 0] == ("Audio", 1, 3) and got["signature", 0][0] == "Author Key (Clipper)" and got["signature", 1][0] == "TTP Key"
    assert json.loads(clips.first()["manifest"])["content"]["type"] == "Derivative"
