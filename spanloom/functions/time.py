"""Times: text forms, days, shifts and ranges. Sessions run in UTC."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that a key can hold, the last one excluded; the quiet period in seconds.
FIRST_DAY, END_DAY = "1970-01-01", "2149-06-07"
QUIET_SECONDS = 300
#: Hours of the preset ranges.
PRESETS = {"1h": 1, "24h": 24, "7d": 168, "30d": 720, "all": None}


def to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis(ts: Column) -> Column:
    """Cut to milliseconds, as the writer stores times."""
    return F.date_trunc("millisecond", ts)


def sort_day(ts: Column) -> Column:
    """The UTC day of a key, null outside the days that a key can hold."""
    day = F.to_date(ts)
    return F.when((day >= F.lit(FIRST_DAY).cast("date")) & (day < F.lit(END_DAY).cast("date")), day)


def shift_micros(ts: Column, micros: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def from_unix_nano(text: Column) -> Column:
    """Nanoseconds as text to milliseconds; null where the text isn't an unsigned number."""
    nanos = F.when(text.rlike(r"^[0-9]{1,20}$"), text).cast("decimal(20,0)")
    return F.timestamp_millis(F.floor(nanos / F.lit(1_000_000)).cast("long"))


def to_unix_nano(ts: Column) -> Column:
    return F.concat(F.unix_millis(ts).cast("string"), F.lit("000000"))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between times that are each cut to milliseconds."""
    return F.unix_millis(end) - F.unix_millis(start)


def settled_before(now: datetime, quiet_seconds: int = QUIET_SECONDS) -> datetime:
    return now - timedelta(seconds=quiet_seconds)


def days_ago(now: datetime, days: int) -> datetime:
    return now - timedelta(days=days)


def preset_from(now: datetime, name: str) -> datetime | None:
    hours = PRESETS[name]
    return None if hours is None else now - timedelta(hours=hours)
