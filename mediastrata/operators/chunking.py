"""Chunking: byte strings and frame sequences to content-addressed chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An audio chunk's longest duration, in microseconds.
MAX_AUDIO_US = 1_000_000
DEFAULT_CAP = 1 << 20


def _checked(cap: int) -> int:
    if cap < 1:
        raise ValueError("the chunk size must be 1 or more")
    return cap


def fixed_size(df: DataFrame, data: Column, cap: int = DEFAULT_CAP, index_col: str = "chunk_index", data_col: str = "data") -> DataFrame:
    """One row for each run of cap bytes, the last shorter; empty and null values have none. Other columns are repeated."""
    _checked(cap)
    length = F.octet_length(data)
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), ((length - 1) / cap).cast("bigint")))
    rows = df.withColumn("__data", data).withColumn(index_col, F.explode(starts))
    return rows.withColumn(data_col, F.substring(F.col("__data"), (F.col(index_col) * cap + 1).cast("int"), F.lit(cap))).drop("__data")


def group_frames(frames: Iterable[tuple[int, int | None, int, bool]], cap: int, max_us: int | None = MAX_AUDIO_US, at_idr: bool = False) -> Iterator[tuple[int, int | None, int, int]]:
    """Runs of frames (bytes, pts, duration, is_idr) as (first frame, pts, frames, bytes).

    A frame begins a new run if the run would exceed cap bytes, or last over max_us, or, with at_idr, if the frame is an IDR;
    a frame larger than cap is a run of its own.
    """
    first, count, size, pts, end = 0, 0, 0, None, 0
    for k, (length, at, duration, idr) in enumerate(frames):
        stop = (at or 0) + max(0, duration)
        if count and (size + length > cap or max_us is not None and max(end, stop) - (pts or 0) > max_us or at_idr and idr):
            yield first, pts, count, size
            count = 0
        if not count:
            first, size, pts, end = k, 0, at, at or 0
        count, size, end = count + 1, size + length, max(end, stop)
    if count:
        yield first, pts, count, size


def group_by_track(frames: DataFrame, keys: list[str], cap: int = DEFAULT_CAP, max_us: int | None = MAX_AUDIO_US, at_idr: bool = False) -> DataFrame:
    """Chunks of tracks whose frames are rows (keys, frame_index, size, pts, duration, is_idr).

    The fold is sequential inside a track; only four numbers of each frame travel, never payloads. Rows: keys, chunk_index, pts,
    first_frame, n_frames, size.
    """
    _checked(cap)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        frames = zip(pdf["size"].tolist(), [None if pd.isna(p) else int(p) for p in pdf["pts"]], pdf["duration"].tolist(), pdf["is_idr"].tolist(), strict=True)
        runs = list(group_frames(frames, cap, max_us, at_idr))
        out = pd.DataFrame([(k, p, int(pdf["frame_index"].iloc[f]), n, s) for k, (f, p, n, s) in enumerate(runs)], columns=["chunk_index", "pts", "first_frame", "n_frames", "size"])
        out["pts"] = out["pts"].astype("Int64")
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = dict(frames.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "chunk_index bigint, pts bigint, first_frame bigint, n_frames bigint, size bigint"])
    rows = frames.select(*keys, "frame_index", F.col("size").cast("bigint").alias("size"), F.col("pts").cast("bigint").alias("pts"), F.coalesce(F.col("duration").cast("bigint"), F.lit(0)).alias("duration"), F.coalesce("is_idr", F.lit(False)).alias("is_idr"))
    return rows.groupBy(*keys).applyInPandas(fold, schema)


def group_at_idr(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The same with IDR frames as the only bounds, as a running sum: no Python, and the partial sums are Spark's."""
    from pyspark.sql import Window

    along = Window.partitionBy(*keys).orderBy("frame_index")
    number = F.sum(F.col("is_idr").cast("bigint")).over(along)
    base = F.first(F.col("is_idr").cast("bigint")).over(along)
    runs = frames.withColumn("chunk_index", number - base)
    return runs.groupBy(*keys, "chunk_index").agg(F.min_by("pts", "frame_index").alias("pts"), F.min("frame_index").alias("first_frame"), F.count("*").alias("n_frames"), F.sum("size").cast("bigint").alias("size"))
