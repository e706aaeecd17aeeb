"""Times without a zone, read as UTC whatever the session's time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_instant(zoneless: Column) -> Column:
    """A zone-free time as the instant it names in UTC (event time must be an instant)."""
    return F.to_timestamp(F.concat(zoneless.cast("string"), F.lit("Z")))


def utc_day(instant: Column) -> Column:
    """The UTC day of an instant, as yyyy-MM-dd."""
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd")
