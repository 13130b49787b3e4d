"""What a byte prefix says about a file, as column expressions. Patterns over bytes run on their hex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signatures, brands and box types.
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "mif1", "msf1")
FIRST_BOXES = ("ftyp", "moov", "moof", "mdat", "free", "skip", "wide", "uuid", "jumb", "meta")
LATER_BOXES = ("ftyp", "moov", "moof", "mdat", "jumb", "meta")
SNIFF_BYTES = 4096
VIDEO_CODECS, AUDIO_CODECS = ("h264", "h265", "hevc"), ("aac", "opus", "flac")
DEMUX = {
    "h264": ("h264", "h264", "h264_mp4toannexb"), "hevc": ("h265", "hevc", "hevc_mp4toannexb"), "h265": ("h265", "hevc", "hevc_mp4toannexb"),
    "aac": ("aac", "adts", None), "opus": ("opus", "opus", None), "flac": ("flac", "flac", None),
}
MUX_FORMATS = {"h264": "h264", "h265": "hevc", "hevc": "hevc", "aac": "aac", "opus": "opus", "flac": "flac", "raw": "data"}
IMAGE_TYPES = ("png", "jpg", "jpeg", "gif", "webp", "heic", "heif")


def latin(data: Column, start: int | Column = 1, length: int | Column = SNIFF_BYTES) -> Column:
    """Bytes as text of one character each, so that string functions see bytes."""
    return F.decode(F.substring(data, F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length), "ISO-8859-1")


def u32_be(data: Column, at: Column | int) -> Column:
    """Four bytes from a 0-based offset, as an unsigned integer."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(4))), 16, 10).cast("bigint")


def is_heif(data: Column) -> Column:
    """An ftyp box whose major brand, or a brand in the box's list, is an image brand."""
    size, box = u32_be(data, 0), F.octet_length(data)
    brands = F.sequence(F.lit(16), F.greatest(size - 4, F.lit(16)).cast("int"), F.lit(4))
    listed = (size >= 20) & (size <= box) & F.exists(brands, lambda at: latin(data, at + 1, 4).isin(*HEIF_BRANDS))
    return (box >= 16) & (latin(data, 5, 4) == "ftyp") & (latin(data, 9, 4).isin(*HEIF_BRANDS) | F.coalesce(listed, F.lit(False)))


def image_type(data: Column) -> Column:
    """png, jpg, gif, webp, heic or null."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("52494646") & head.endswith("57454250") & (F.length(head) == 24), "webp")
        .when(is_heif(data), "heic")
    )


def is_isobmff(data: Column) -> Column:
    """A known first box, or a known box among those that follow one another in the sniffed prefix.

    The walk is a fold over at most SNIFF_BYTES / 8 steps: state is the next box's offset, or -1 when found and -2 when over.
    """
    scan = F.least(F.octet_length(data), F.lit(SNIFF_BYTES))
    kind = latin(data, 5, 4)

    def step(at: Column, _: Column) -> Column:
        size = u32_be(data, at)
        return (
            F.when(at < 0, at)
            .when(at + 8 > scan, F.lit(-2))
            .when(latin(data, at + 5, 4).isin(*LATER_BOXES), F.lit(-1))
            .when((size < 8) | (size > scan - at), F.lit(-2))
            .otherwise(at + size.cast("int"))
        )

    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), (scan / 8).cast("int"))), F.lit(0), step) == -1
    return F.coalesce((F.octet_length(data) >= 12) & kind.rlike("^[A-Za-z0-9]{4}$") & (kind.isin(*FIRST_BOXES) | walk), F.lit(False))


def container_type(data: Column) -> Column:
    """mp4, webm, mkv or null."""
    return F.when(is_isobmff(data), "mp4").when(
        F.hex(F.substring(data, 1, 4)) == "1A45DFA3", F.when(F.lower(latin(data)).contains("webm"), "webm").otherwise("mkv")
    )


def track_label(container: Column, codec: Column, width: Column, height: Column, rate: Column, channels: Column) -> Column:
    """Image, Video, Audio or Unknown."""
    return (
        F.when(F.lower(container).isin(*IMAGE_TYPES), "Image")
        .when(width.isNotNull() | height.isNotNull() | F.lower(codec).isin(*VIDEO_CODECS), "Video")
        .when(rate.isNotNull() | channels.isNotNull() | F.lower(codec).isin(*AUDIO_CODECS), "Audio")
        .otherwise("Unknown")
    )


def extension_matches(extension: Column, container: Column) -> Column:
    """Whether a file extension fits a container type; jpg is jpeg and heic is heif."""
    same = lambda c: F.when(F.lower(c) == "jpeg", "jpg").when(F.lower(c) == "heif", "heic").otherwise(F.lower(c))
    return same(extension) == same(container)


def demux_parameters(codec: Column) -> Column:
    """struct(codec, format, filter) of a stream that can be demuxed, else null."""
    known = F.create_map(*[x for k, v in DEMUX.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("codec"), F.lit(v[1]).alias("format"), F.lit(v[2]).cast("string").alias("filter")))])
    return F.try_element_at(known, codec)


def mux_format(codec: Column) -> Column:
    known = F.create_map(*[x for k, v in MUX_FORMATS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(known, F.lower(codec))


def demuxable(streams: DataFrame, keys: list[str], kind: str = "codec_type", codec: str = "codec_name", index: str = "index") -> DataFrame:
    """A container's streams that are demuxed: audio and video of supported codecs; track_ord numbers them by index."""
    kept = streams.where(F.col(kind).isin("video", "audio") & demux_parameters(F.col(codec)).isNotNull())
    return kept.withColumn("track_ord", F.row_number().over(Window.partitionBy(*keys).orderBy(index)).cast("bigint") - 1)


def lower_tags(tags: Column) -> Column:
    """Tags with lower-case keys; of keys that are then equal the last counts."""
    pairs = F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.transform(pairs, lambda p, j: F.struct(p["key"].alias("key"), j.alias("j"))), lambda p: (p["key"] == e["key"]) & (p["j"] > i)))
    return F.map_from_entries(last)
