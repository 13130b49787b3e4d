"""Small facts of codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediastrata.functions.detect import latin
from mediastrata.sources.bitstream import ADTS_RATES, FLAC_RATES


def nal_kind(first_byte: Column, codec: Column) -> Column:
    """struct(type, is_idr, is_slice) of a NAL unit's first byte, for h264 or h265."""
    h264 = first_byte.bitwiseAND(F.lit(31))
    h265 = F.shiftright(first_byte, 1).bitwiseAND(F.lit(63))
    kind = F.when(codec == "h264", h264).otherwise(h265)
    idr = F.when(codec == "h264", kind == 5).otherwise(kind.isin(19, 20))
    is_slice = F.when(codec == "h264", kind.between(1, 5)).otherwise(kind <= 31)
    return F.struct(kind.alias("type"), idr.alias("is_idr"), is_slice.alias("is_slice"))


def codec_vote(first_bytes: Column) -> Column:
    """h264 or h265, from the first ten units' first bytes; a tie is h264."""
    head = F.slice(first_bytes, 1, 10)
    votes = lambda kinds, kind: F.size(F.filter(head, lambda b: kind(b).isin(*kinds)))
    h264 = votes((1, 5, 7, 8), lambda b: b.bitwiseAND(F.lit(31)))
    h265 = votes((1, 19, 20, 32, 33, 34), lambda b: F.shiftright(b, 1).bitwiseAND(F.lit(63)))
    return F.when(h265 > h264, "h265").otherwise("h264")


def aac_config(object_type: Column, rate_index: Column, channels: Column) -> Column:
    """The AudioSpecificConfig, as hex."""
    masked = lambda c, m, by: F.shiftleft(c.bitwiseAND(F.lit(m)), by)
    packed = masked(object_type, 31, 11).bitwiseOR(masked(rate_index, 15, 7)).bitwiseOR(masked(channels, 15, 3))
    return F.lower(F.lpad(F.hex(packed.cast("bigint")), 4, "0"))


def adts_rate(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, ADTS_RATES)), index)


def flac_block_size(code: Column) -> Column:
    """Samples in a frame by its header's code; null where they follow the header, or for the reserved code."""
    return F.when(code == 1, 192).when(code.between(2, 5), 144 * F.pow(F.lit(2), code)).when(code.between(8, 15), F.pow(F.lit(2), code)).cast("bigint")


def flac_rate(code: Column, stream_rate: Column) -> Column:
    """A frame's rate by its header's code; null where it follows the header, or for the reserved code."""
    known = F.create_map(*[F.lit(x) for pair in FLAC_RATES.items() for x in pair])
    return F.when(code == 0, stream_rate.cast("bigint")).otherwise(F.try_element_at(known, code).cast("bigint"))


def opus_head(data: Column) -> Column:
    """struct(rate, channels) of the first identification header anywhere; null without one."""
    at = F.instr(F.decode(data, "ISO-8859-1"), "OpusHead")
    byte = lambda k: F.conv(F.hex(F.substring(data, at + k, F.lit(1))), 16, 10).cast("bigint")
    rate = byte(12) + 256 * byte(13) + 65536 * byte(14) + 16777216 * byte(15)
    return F.when((at > 0) & (at + 18 <= F.octet_length(data)), F.struct(rate.alias("rate"), byte(9).alias("channels")))


def without_emulation(data: Column) -> Column:
    """00 00 03 to 00 00, left to right."""
    return F.encode(F.replace(F.decode(data, "ISO-8859-1"), F.lit("\0\0\3"), F.lit("\0\0")), "ISO-8859-1")


def annexb_extradata(units: Column) -> Column:
    """The units that aren't empty, each after a start code, as hex."""
    used = F.filter(units, lambda u: u.isNotNull() & (F.octet_length(u) > 0))
    return F.array_join(F.transform(used, lambda u: F.concat(F.lit("00000001"), F.lower(F.hex(u)))), "")


def with_extradata(first_chunk: Column, extradata_hex: Column, codec: Column) -> Column:
    """Video's first chunk with its parameter sets before it, unless it begins with them."""
    extra = F.coalesce(F.unhex(extradata_hex), F.lit(b""))
    begins = F.substring(F.hex(first_chunk), F.lit(1), F.length(extradata_hex)) == F.upper(extradata_hex)
    return F.when(codec.isin("h264", "h265", "hevc") & ~F.coalesce(begins, F.lit(True)), F.concat(extra, first_chunk)).otherwise(first_chunk)


def pages_timing(granules: Column) -> Column:
    """Opus pages' (pts_us, duration_us) from their granule positions in order: a page lasts as long as its position is beyond the last known."""
    zero = F.struct(F.lit(None).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("samples"), F.array().cast("array<struct<pts_us: bigint, duration_us: bigint>>").alias("out"))

    def step(s: Column, g: Column) -> Column:
        lasts = F.greatest(F.coalesce(g - s["before"], F.lit(0)), F.lit(0)).cast("bigint")
        us = lambda n: F.floor(n * 1000000 / F.lit(48000)).cast("bigint")
        page = F.struct(us(s["samples"]).alias("pts_us"), us(lasts).alias("duration_us"))
        return F.struct(F.coalesce(g, s["before"]).alias("before"), (s["samples"] + lasts).alias("samples"), F.concat(s["out"], F.array(page)).alias("out"))

    return F.aggregate(granules, zero, step, lambda s: s["out"])


def starts_with(data: Column, hexed: str) -> Column:
    return latin(data, 1, len(hexed) // 2) == F.decode(F.unhex(F.lit(hexed)), "ISO-8859-1")
