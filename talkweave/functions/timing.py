"""Clock formats and interval arithmetic. Times are DOUBLE seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def srt_clock(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``, milliseconds truncated."""
    ms = (seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000),
                           F.floor(ms % 60000 / 1000), ms % 1000)


def clock(seconds: Column) -> Column:
    """``HH:MM:SS``."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def short_duration(seconds: Column) -> Column:
    """``2h 5m`` or ``5m``."""
    s = seconds.cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def timer(seconds: Column) -> Column:
    """``mm:ss`` or ``h:mm:ss``, never negative."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the shorter interval, at most 1; 0 when the shorter one has no length."""
    shorter = F.least(a1 - a0, b1 - b0)
    ratio = F.least(F.try_divide(overlap_seconds(a0, a1, b0, b1), shorter), F.lit(1.0))
    return F.when(shorter > 0, ratio).otherwise(F.lit(0.0))


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso8601(text: Column) -> Column:
    """With or without fractional seconds; anything else is null."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
    return F.when(text.rlike(shape), text.try_cast("timestamp"))


def real_time_factor(audio_s: Column, wall_s: Column) -> Column:
    return F.when(wall_s > 0, F.try_divide(audio_s, wall_s)).otherwise(F.lit(0.0))
