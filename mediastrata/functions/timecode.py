"""Presentation times: ticks of a rational timebase to seconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _known(num: Column, den: Column) -> Column:
    return num.isNotNull() & den.isNotNull() & (num != 0) & (den != 0)


def pts_to_seconds(pts: Column, num: Column, den: Column) -> Column:
    """pts * num / den; null without a timebase."""
    return F.when(_known(num, den), pts.cast("double") * num.cast("double") / den.cast("double"))


def _ticks(seconds: Column, num: Column, den: Column) -> Column:
    usable = _known(num, den) & (seconds >= 0) & ~F.isnan(seconds) & (seconds < float("inf"))
    return F.when(usable, seconds * den.cast("double") / num.cast("double"))


def seconds_to_pts_floor(seconds: Column, num: Column, den: Column) -> Column:
    """The last tick not after a time; null for times that are negative or not finite, and without a timebase."""
    return F.floor(_ticks(seconds, num, den)).cast("bigint")


def seconds_to_pts_ceil(seconds: Column, num: Column, den: Column) -> Column:
    """The first tick not before a time; null likewise."""
    return F.ceil(_ticks(seconds, num, den)).cast("bigint")


def samples_to_us(samples: Column, rate: Column) -> Column:
    """Whole microseconds of a number of samples; 0 for rate 0."""
    exact = F.expr("1000000").cast("decimal(38,0)") * samples.cast("decimal(20,0)")
    return F.when(rate == 0, F.lit(0)).otherwise(F.least(F.floor(exact / F.nullif(rate, F.lit(0))), F.lit(2**63 - 1)).cast("bigint"))
