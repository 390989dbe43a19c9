"""Time text, ISO text, interval lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(text: Column) -> Column:
    """Time text to a timestamp; nanoseconds are cut to microseconds, bad text gives null."""
    return text.try_cast("timestamp_ntz")


def iso_text(ts: Column, zone: str = "+00:00") -> Column:
    """ISO 8601 text of a UTC time; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit(zone))


def interval_seconds(start: Column, end: Column) -> Column:
    """Length of an interval in seconds, with microseconds kept."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000.0)
