"""Timestamps out of epoch numbers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.binding import transformation
from tributary.types import as_type, try_to

#: Fixed limits: numbers up to this size are seconds, larger ones milliseconds; and the outer limits.
MAX_SECONDS, MIN_MS, MAX_MS = 4102358400, -62135514321000, 253402210800000


@transformation
def to_timestamp(value: Column, max_timestamp_sec=MAX_SECONDS, input_format=False, output_format=False, min_timestamp_ms=MIN_MS, max_timestamp_ms=MAX_MS, cast="timestamp") -> Column:
    """Seconds, milliseconds or text as a timestamp, read in the session's zone where none is given.

    ``input_format`` reads by that pattern only. ``output_format`` gives text and overrides ``cast``. A whole
    number outside the limits, and anything unreadable, is NULL.
    """
    text = value.cast("string")
    if input_format:
        stamp = F.try_to_timestamp(text, F.lit(input_format))
    else:
        bare = F.trim(text)
        whole = try_to(bare, "bigint")
        ms = F.timestamp_millis(F.when(F.abs(whole) <= max_timestamp_sec, whole * 1000).otherwise(whole))
        stamp = F.when(whole.between(min_timestamp_ms, max_timestamp_ms), ms).when(whole.isNull(), F.try_to_timestamp(bare))
    return F.date_format(stamp, output_format) if output_format else try_to(stamp, as_type(cast))
