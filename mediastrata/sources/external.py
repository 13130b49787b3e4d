"""Optional steps by external tools: containers to elementary streams, streams to containers, and tags of media files.

They need ffprobe and ffmpeg on every executor's path; where one is absent the step fails with MissingTool. A tool reads and writes files, so
each task gives it a folder of its own that is gone when the call ends; nothing else is kept there. Each file is one call.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediastrata.functions.detect import DEMUX, MUX_FORMATS, VIDEO_CODECS


class MissingTool(RuntimeError):
    """An external tool that a step needs isn't installed."""


class ToolFailed(RuntimeError):
    """An external tool ended with an error."""


def run(tool: str, *arguments: str) -> bytes:
    """What the tool prints."""
    path = shutil.which(tool)
    if path is None:
        raise MissingTool(f"{tool} isn't on the path of this executor; containers can only be read or written where it is installed")
    done = subprocess.run([path, *arguments], capture_output=True, check=False)
    if done.returncode:
        raise ToolFailed(f"{tool} failed with status {done.returncode}: {done.stderr.decode(errors='replace')[-300:].strip()}")
    return done.stdout


def _put(folder: str, name: str, data: bytes) -> str:
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def streams(data: bytes, container: str) -> Iterator[tuple[int, str, bytes]]:
    """(index, codec, bytes) of a container's audio and video streams of supported codecs, in order of their indexes."""
    with tempfile.TemporaryDirectory() as folder:
        source = _put(folder, f"in.{container}", data)
        probed = json.loads(run("ffprobe", "-v", "quiet", "-print_format", "json", "-show_streams", source))
        found = [(s["index"], str(s["codec_name"]).lower()) for s in probed.get("streams") or [] if s.get("codec_type") in ("video", "audio") and s.get("codec_name") and s.get("index") is not None]
        for index, name in sorted(f for f in found if f[1] in DEMUX):
            _, form, bits = DEMUX[name]
            target = os.path.join(folder, f"{index}.bin")
            run("ffmpeg", "-y", "-i", source, "-map", f"0:{index}", "-c", "copy", *(("-bsf:v", bits) if bits else ()), "-f", form, target)
            with open(target, "rb") as f:
                yield index, name, f.read()


def demux(files: DataFrame, keys: list[str], data_col: str = "data", container_col: str = "container_type") -> DataFrame:
    """keys, input_ord (from 0), codec, container_type and data of each file's streams, as media.chunk_tracks takes them with codec_col."""
    schema = T.StructType([*files.select(*keys).schema.fields, *T.StructType.fromDDL("input_ord bigint, codec string, container_type string, data binary").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                kind = batch.column(len(keys))[k].as_py()
                for n, (_, codec, data) in enumerate(streams(batch.column(len(keys) + 1)[k].as_py() or b"", kind or "bin")):
                    own = [batch.column(c).slice(k, 1) for c in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([n], pa.int64()), pa.array([codec]), pa.array([kind], pa.string()), pa.array([data], pa.binary())], names=schema.names)

    return files.select(*keys, container_col, data_col).mapInArrow(each, schema)


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def _tags(data: pa.Array) -> pa.Array:
    out: list[Any] = []
    for content in data.to_pylist():
        with tempfile.TemporaryDirectory() as folder:
            probed = json.loads(run("ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", _put(folder, "in.bin", content or b"")))
        found = (probed.get("format") or {}).get("tags")
        out.append(None if found is None else list({str(k).lower(): str(v) for k, v in found.items()}.items()))
    return pa.array(out, pa.map_(pa.string(), pa.string()))


def read_tags(files: DataFrame, data_col: str = "data") -> DataFrame:
    """Adds tags: a media file's embedded tags with lower-case keys; null where it has none."""
    return files.withColumn("tags", _tags(F.col(data_col)))


def muxed(tracks: list[dict[str, Any]], tags: dict[str, str], extension: str) -> bytes:
    """One container of elementary streams (codec, timebase_num, timebase_den, data), copied as they are, with tags."""
    with tempfile.TemporaryDirectory() as folder:
        inputs: list[str] = []
        for k, t in enumerate(tracks):
            codec, num, den = t["codec"].lower(), t.get("timebase_num") or 0, t.get("timebase_den") or 0
            if codec not in MUX_FORMATS:
                raise ValueError(f"codec {t['codec']} can't be muxed")
            rate = ["-r", f"{den}/{num}"] if num > 0 and den > 0 and codec in VIDEO_CODECS else []
            inputs += [*rate, "-f", MUX_FORMATS[codec], "-i", _put(folder, f"{k}.bin", bytes(t["data"]))]
        flags = ["-movflags", "use_metadata_tags"] if extension == "mp4" else []
        told = [x for key, value in tags.items() for x in ("-metadata", f"{key}={value}")]
        target = os.path.join(folder, f"out.{extension}")
        run("ffmpeg", "-y", "-fflags", "+genpts", "-avoid_negative_ts", "make_zero", *inputs, *flags, *told, "-c", "copy", target)
        with open(target, "rb") as f:
            return f.read()
