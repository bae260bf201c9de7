"""Event-time helpers on TIMESTAMP_NTZ (independent of the session time zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_micros(col) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ (exact integer)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _c(col).cast("timestamp_ntz"))


def epoch_nanos(col) -> Column:
    """Nanoseconds since the epoch; exact (the reference's float product loses digits)."""
    return epoch_micros(col) * F.lit(1000)


def from_epoch_micros(col) -> Column:
    """Inverse of :func:`epoch_micros`, giving TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", _c(col), F.expr(_EPOCH))


def from_epoch_seconds(col) -> Column:
    """TIMESTAMP_NTZ from (fractional) epoch seconds, at microsecond precision."""
    return from_epoch_micros((_c(col) * F.lit(1_000_000)).cast("long"))


def ts_text_ms(col) -> Column:
    """``YYYY-mm-dd HH:MM:SS.mmm`` (milliseconds truncated), task-log text time."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss.SSS")


def ts_text_s(col) -> Column:
    """``YYYY-mm-dd HH:MM:SS``: component-log and metric text time."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss")


def time_bucket(col, seconds: int) -> Column:
    """Integer bucket number of a timestamp for ``seconds``-wide buckets."""
    return F.floor(epoch_micros(col) / F.lit(seconds * 1_000_000)).cast("long")
