"""Media files to tracks of chunks: image and container detection, parsing, grouping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediastrata.functions import detect
from mediastrata.operators.chunking import DEFAULT_CAP, MAX_AUDIO_US, group_frames
from mediastrata.sources import bitstream

TRACK = "codec string, container_type string, codec_extradata string, width bigint, height bigint, sample_rate bigint, channel_count int, timebase_num bigint, timebase_den bigint"
CHUNK = "chunk_index bigint, pts bigint, is_idr boolean, data binary, at bigint"

#: Bytes of small files' chunks that leave a task at once, about.
BATCH_BYTES = 4 << 20


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, data) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def stream_chunks(data: bytes, stream: bitstream.Stream | None, cap: int) -> Iterator[tuple[int | None, bool, bytes]]:
    """(pts, holds an IDR, bytes) of a stream's chunks; runs of cap bytes where it has no frames."""
    if stream is None or not stream.frames:
        for at in range(0, len(data), cap):
            yield None, False, data[at : at + cap]
        return
    video = stream.codec in detect.VIDEO_CODECS
    frames = stream.frames
    for first, pts, count, _ in group_frames(((f.length, f.pts, f.duration, f.is_idr) for f in frames), cap, None if video else MAX_AUDIO_US, video):
        run = frames[first : first + count]
        part = b"".join([data[f.start : f.start + f.length] for f in run])
        yield pts, any(f.is_idr for f in run) and bitstream.holds_idr(part), part


def chunk_tracks(files: DataFrame, keys: list[str], data_col: str = "data", codec_col: str | None = None, container_col: str | None = None, cap: int = DEFAULT_CAP) -> DataFrame:
    """One row per chunk: keys, the track's facts, chunk_index, pts, is_idr, data, and at, the bytes of the input's earlier chunks.

    Images stay opaque. With codec_col, rows are demuxed streams of a container (container_col) and are parsed by their codec; codecs
    that aren't supported have no rows. Otherwise elementary streams are recognized by their bytes, and all else, containers
    that nobody demuxed included, is one opaque track of fixed-size chunks. An empty file has no chunks.
    """
    if cap < 1:
        raise ValueError("the chunk size must be 1 or more")
    data = F.col(data_col)
    image = detect.image_type(data)
    kind = F.col(container_col) if container_col else F.coalesce(image, detect.container_type(data))
    opaque = F.lit(False) if codec_col else kind.isNotNull()
    rows = files.select(*keys, data.alias("__data"), (F.col(codec_col) if codec_col else F.lit(None).cast("string")).alias("__codec"), kind.alias("__kind"), opaque.alias("__opaque"))
    kinds = dict(files.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), TRACK, CHUNK])
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def made(rows: list[list], to: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to, strict=True)], schema=to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = None
        for batch in batches:
            to = to or pa.schema([batch.schema.field(k) for k in range(len(keys))] + [pa.field(n, t) for n, t in zip(names[len(keys) :], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()), strict=True)])
            out, held = [], 0
            for row in batch.to_pylist():
                content, codec = row["__data"] or b"", row["__codec"]
                stream = None if row["__opaque"] else bitstream.by_codec(content, codec) if codec else bitstream.elementary(content)
                if stream is None and codec:
                    continue
                s = stream or bitstream.Stream("raw")
                num, den = s.timebase or (None, None)
                facts = [row[k] for k in keys] + [s.codec, row["__kind"], s.extradata.hex() if s.extradata is not None else None, s.width, s.height, s.sample_rate, s.channels, num, den]
                at = 0
                for k, (pts, idr, part) in enumerate(stream_chunks(content, stream, cap)):
                    out.append([*facts, k, pts, idr, part, at])
                    at += len(part)
                held += at
                if held >= BATCH_BYTES:
                    yield made(out, to)
                    out, held = [], 0
            if out:
                yield made(out, to)

    return rows.mapInArrow(run, schema)


@F.arrow_udf(T.BooleanType())
def _idr(data: pa.Array, codec: pa.Array) -> pa.Array:
    return pa.array([(c or "") in detect.VIDEO_CODECS and bitstream.holds_idr(d or b"") for d, c in zip(data.to_pylist(), codec.to_pylist(), strict=True)], pa.bool_())


#: Parsers of whole streams by name, as frames() takes them.
PARSERS = {"adts": bitstream.adts, "opus": bitstream.ogg_opus, "flac": bitstream.flac, "annexb": bitstream.annexb, "elementary": bitstream.elementary}
FRAME = "frame_index bigint, start bigint, length bigint, pts bigint, duration bigint, is_idr boolean, codec string, extradata string, sample_rate bigint, channels bigint"


def frames(files: DataFrame, keys: list[str], parser: str, data_col: str = "data") -> DataFrame:
    """One row per frame (page, unit) of each stream, with the stream's facts; bytes that aren't such a stream, or null, have none."""
    schema = T.StructType([*(f for f in files.select(*keys).schema.fields), *T.StructType.fromDDL(FRAME).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = PARSERS[parser]
        for batch in batches:
            for k in range(batch.num_rows):
                stream = read(batch.column(batch.num_columns - 1)[k].as_py() or b"")
                if stream is None or not stream.frames:
                    continue
                n = len(stream.frames)
                own = [pa.repeat(batch.column(c)[k], n) for c in range(len(keys))]
                each = zip(*[(i, f.start, f.length, f.pts, f.duration, f.is_idr) for i, f in enumerate(stream.frames)], strict=True)
                facts = (stream.codec, stream.extradata.hex() if stream.extradata is not None else None, stream.sample_rate, stream.channels)
                kinds = [pa.int64()] * 5 + [pa.bool_()]
                told = [pa.array([x] * n, t) for x, t in zip(facts, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(each, kinds, strict=True)), *told], names=schema.names)

    return files.select(*keys, F.col(data_col)).mapInArrow(run, schema)


_SIZE = T.StructType([T.StructField(n, T.LongType()) for n in ("width", "height", "timebase_num", "timebase_den")])


@F.arrow_udf(_SIZE)
def _parameter_set(sps: pa.Array) -> pa.Array:
    out = []
    for x in sps.to_pylist():
        size, base = (None, None) if x is None else bitstream.h264_parameters(x)
        out.append({"width": size and size[0], "height": size and size[1], "timebase_num": base and base[0], "timebase_den": base and base[1]})
    return pa.array(out, pa.struct([(n, pa.int64()) for n in _SIZE.names]))


def parameter_set(sps: Column) -> Column:
    """struct(width, height, timebase_num, timebase_den) of H.264 sequence parameter sets, each with its NAL header; null where it doesn't say."""
    return _parameter_set(sps)


def first_track(chunks: DataFrame, keys: list[str], order: str = "input_ord") -> DataFrame:
    """The chunks of each key's first track: of the least `order` that has any. A key without tracks has no rows."""
    least = chunks.groupBy(*keys).agg(F.min(order).alias("__first"))
    return chunks.join(least, keys).where(F.col(order) == F.col("__first")).drop("__first")


def idr_column(data: Column, codec: Column) -> Column:
    """Whether each chunk holds a random access point; false for tracks that aren't video."""
    return _idr(data, codec)
