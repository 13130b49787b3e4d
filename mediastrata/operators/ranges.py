"""Time ranges to chunk ranges and back, clip selection, and snapping to random access points.

Chunk indexes are rows (keys, chunk_index, pts). Requests are rows with the same keys and their own bounds. A bound finds its chunk by an
as-of join: requests and chunks of a track are dealt into buckets of the track's numbers and pass in order, once; what a bucket
doesn't hold itself comes from the nearest one that isn't empty. No request meets the chunks of a track one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediastrata.functions.timecode import pts_to_seconds, seconds_to_pts_ceil, seconds_to_pts_floor


#: Chunks of a track in a bucket of an as-of join, about.
BUCKET_CHUNKS = 1 << 16


def nearest(asked: DataFrame, points: DataFrame, keys: list[str], request: str, lookups: dict[str, tuple[str, bool]]) -> DataFrame:
    """asked, with a column for each lookup {column: (number's column, after)}: the value of the last point at or before the number.

    after: of the first point at or after it. points: keys, number, value; of points of one number the largest value counts (after: the least).
    Null: there is none, or the number is null. request and keys tell the rows of asked apart; asked is read once.
    """
    span = points.groupBy(*keys).agg(F.min("number").alias("__low"), F.max("number").alias("__high"), F.ceil(F.count("*") / BUCKET_CHUNKS).alias("__count"))

    def bucket(x: Column) -> Column:
        share = (x - F.col("__low")) / (F.col("__high") - F.col("__low") + 1)
        return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * F.col("__count")).cast("bigint").alias("__bucket")

    once = points.groupBy(*keys, "number").agg(F.max("value").alias("__late"), F.min("value").alias("__early")).join(span, keys)
    once = once.select(*keys, bucket(F.col("number")), F.col("number").cast("bigint").alias("__x"), "__late", "__early")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(at).cast("bigint").alias("x")) for name, (at, _) in lookups.items()]))
    row = F.struct(*[F.col(f"`{c}`") for c in asked.columns])
    wanted = asked.select(*keys, row.alias("__row"), each.alias("__want")).join(span, keys, "left")
    wanted = wanted.select(*keys, bucket(F.col("__want.x")), F.col("__want.x").alias("__x"), "__row", F.col("__want.name").alias("__name"))
    both = once.unionByName(wanted, allowMissingColumns=True)
    own, points_first = Window.partitionBy(*keys, "__bucket"), F.col("__name").isNotNull()
    upto = own.orderBy("__x", points_first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    downto = own.orderBy(F.desc("__x"), points_first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumns({"__before": F.last("__late", ignorenulls=True).over(upto), "__after": F.last("__early", ignorenulls=True).over(downto)}).where("__name IS NOT NULL")
    ends = once.groupBy(*keys, "__bucket").agg(F.max_by("__late", "__x").alias("__end"), F.min_by("__early", "__x").alias("__begin"))
    every = span.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__count"))).alias("__bucket")).join(ends, [*keys, "__bucket"], "left")
    along = Window.partitionBy(*keys)
    earlier = along.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    later = along.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "__bucket", F.last("__end", ignorenulls=True).over(earlier).alias("__from_before"), F.last("__begin", ignorenulls=True).over(later).alias("__from_after"))
    found = here.join(carried, [*keys, "__bucket"], "left")
    after = F.col("__name").isin([name for name, (_, is_after) in lookups.items() if is_after])
    answer = F.when(F.col("__x").isNotNull(), F.when(after, F.coalesce("__after", "__from_after")).otherwise(F.coalesce("__before", "__from_before")))
    got = found.groupBy(F.col(f"__row.{request}").alias("__request"), *keys).agg(F.first("__row").alias("__row"), *[F.max(F.when(F.col("__name") == name, answer)).alias(name) for name in lookups])
    return got.select("__row.*", *lookups)


def time_to_chunks(requests: DataFrame, chunks: DataFrame, keys: list[str], request: str = "request_id", start: str = "start_time", end: str = "end_time", num: str = "timebase_num", den: str = "timebase_den", order: str = "chunk_index") -> DataFrame:
    """request, first_chunk and end_chunk (exclusive) of each time range [start, end).

    The start is the last chunk at or before it (of equal pts the last; else the first chunk); the end is the first chunk at or after it
    (of equal pts the first; else one past the last). An open start is the first chunk's, an open end one tick past the last's. Chunks
    without a pts don't count. Null: no such chunk, no timebase, an unusable time, or an empty range.
    """
    n, d = F.col(num), F.col(den)
    asked = requests.select(request, *keys, n.alias("__n"), d.alias("__d"), F.col(start).cast("double").alias("__s"), F.col(end).cast("double").alias("__e"))
    timed = chunks.where(F.col("pts").isNotNull()).select(*keys, F.col("pts").alias("number"), F.col(order).alias("value"))
    place = F.struct("number", "value")
    bounds = timed.groupBy(*keys).agg(F.min(place).alias("__first"), F.max(place).alias("__last"))
    asked = asked.join(bounds, keys)
    s = F.when(F.col("__s").isNull(), F.col("__first.number")).otherwise(seconds_to_pts_floor(F.col("__s"), F.col("__n"), F.col("__d")))
    e = F.when(F.col("__e").isNull(), F.col("__last.number") + 1).otherwise(seconds_to_pts_ceil(F.col("__e"), F.col("__n"), F.col("__d")))
    base = F.col("__n").isNotNull() & F.col("__d").isNotNull() & (F.col("__n") != 0) & (F.col("__d") != 0)
    asked = asked.select(request, *keys, F.when(base, s).alias("__from"), F.when(base, e).alias("__to"), "__first", "__last")
    found = nearest(asked, timed, keys, request, {"__start": ("__from", False), "__stop": ("__to", True)})
    first = F.coalesce(F.col("__start"), F.col("__first.value"))
    stop = F.coalesce(F.col("__stop"), F.col("__last.value") + 1)
    usable = F.col("__from").isNotNull() & F.col("__to").isNotNull() & (first < stop)
    return requests.select(request).join(found.select(request, F.when(usable, first).alias("first_chunk"), F.when(usable, stop).alias("end_chunk")), request, "left")


def chunks_to_time(requests: DataFrame, chunks: DataFrame, keys: list[str], request: str = "request_id", first: str = "first_chunk", end: str = "end_chunk", num: str = "timebase_num", den: str = "timebase_den", order: str = "chunk_index") -> DataFrame:
    """request, start_time and end_time of each chunk range [first, end).

    The start is the first chunk's at or after `first`; the end that of the first chunk at or after `end`, else one second's ticks
    (den div max(num, 1)) past the last chunk inside. Null where the range is empty or holds no timed chunk.
    """
    asked = requests.select(request, *keys, F.col(num).alias("__n"), F.col(den).alias("__d"), F.col(first).alias("__f"), F.col(end).alias("__e"), (F.col(end) - 1).alias("__l"))
    timed = chunks.where(F.col("pts").isNotNull()).select(*keys, F.col(order).alias("number"), F.struct(F.col(order).alias("i"), F.col("pts").alias("p")).alias("value"))
    found = nearest(asked, timed, keys, request, {"__start": ("__f", True), "__next": ("__e", True), "__last": ("__l", False)})
    step = F.floor(F.col("__d") / F.greatest(F.col("__n"), F.lit(1)))
    inside = F.when(F.col("__last.i") >= F.col("__f"), F.col("__last.p"))
    stop = F.coalesce(F.col("__next.p"), inside + step)
    n, d = F.col("__n"), F.col("__d")
    ok = (F.col("__f") < F.col("__e")) & F.col("__start").isNotNull() & stop.isNotNull()
    out = found.select(request, F.when(ok, pts_to_seconds(F.col("__start.p"), n, d)).alias("start_time"), F.when(ok, pts_to_seconds(stop, n, d)).alias("end_time"))
    return requests.select(request).join(out, request, "left")


def range_kind(start_time: Column, end_time: Column, start: Column, end: Column) -> Column:
    """Which of a request's bounds count: both times, else both indexes, else the one time there is; null: none."""
    return (
        F.when(start_time.isNotNull() & end_time.isNotNull(), "time")
        .when(start.isNotNull() & end.isNotNull(), "index")
        .when(start_time.isNotNull() | end_time.isNotNull(), "open_time")
    )


def select_clip(ranges: DataFrame, chunks: DataFrame, keys: list[str], first: str = "first_chunk", end: str = "end_chunk", order: str = "chunk_index", stride: int = 64) -> DataFrame:
    """The chunks of each range [first, end): an equi-join on the track and on runs of `stride` indexes, then the exact bounds.

    Ranges are repeated for each run they touch, so that a long track under many requests is dealt out by runs.
    """
    runs = F.sequence(F.floor(F.col(first) / stride), F.floor((F.col(end) - 1) / stride))
    asked = ranges.where(F.col(first) < F.col(end)).withColumn("__run", F.explode(runs))
    rows = chunks.withColumn("__run", F.floor(F.col(order) / stride))
    return asked.join(rows, [*keys, "__run"]).where((F.col(order) >= F.col(first)) & (F.col(order) < F.col(end))).drop("__run")


def snap_to_idr(requests: DataFrame, chunks: DataFrame, keys: list[str], request: str = "request_id", start: str = "first_chunk", is_idr: str = "is_idr", order: str = "chunk_index") -> DataFrame:
    """request, keys and idr_chunk: the last chunk with an IDR at or before the start (of a start past the end: before the end).

    Null where there is none. Positions and indexes are one and the same here: a clip's chunks are found by their own indexes.
    """
    flagged = chunks.where(F.col(is_idr)).select(*keys, F.col(order).alias("number"), F.col(order).alias("value"))
    asked = requests.select(request, *keys, F.col(start).alias("__s"))
    return nearest(asked, flagged, keys, request, {"idr_chunk": ("__s", False)}).select(request, *keys, "idr_chunk")


def snap_across_tracks(snapped: DataFrame, requests: DataFrame, request: str = "request_id", start: str = "first_chunk") -> DataFrame:
    """request and start: the least snapped start over its video tracks, but no later than asked; tracks that didn't snap don't count."""
    least = snapped.groupBy(request).agg(F.min("idr_chunk").alias("__least"))
    return requests.select(request, start).join(least, request, "left").select(request, F.least(F.col(start), F.col("__least")).alias("snapped_start"))
