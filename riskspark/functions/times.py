"""Time helpers: an explicit ``as_of`` replaces the wall clock everywhere."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The trailing windows and their length in hours.
WINDOW_HOURS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720, "90d": 2160}

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000


def as_time(value: str | datetime | Column) -> Column:
    """A time-zone-free timestamp from text, a datetime or a column."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def hours_before(as_of, hours: int) -> Column:
    return as_time(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))


def within(ts: Column | str, as_of, hours: int) -> Column:
    """``as_of - hours <= ts <= as_of``."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return (column >= hours_before(as_of, hours)) & (column <= as_time(as_of))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY_US)).cast("bigint")
