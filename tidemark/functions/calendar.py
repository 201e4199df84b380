"""Market time: intervals are stamped by their end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands by the hour in which an interval starts.
BANDS = (("overnight", 0), ("morning", 6), ("midday", 9), ("afternoon", 15), ("evening", 17), ("late", 21))
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def interval_end(ts: Column, minutes: int = 30) -> Column:
    """The end of the interval (start, end] that ts lies in."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts.cast("timestamp_ntz"))
    steps = -F.floor(-micros / F.lit(minutes * 60_000_000))
    return F.timestamp_add("MINUTE", (steps * minutes).cast("int"), F.expr(EPOCH))


def operating_day(ts: Column) -> Column:
    """Day d owns (d 00:00, d+1 00:00]."""
    return F.to_date(ts.cast("timestamp_ntz") - F.expr("interval 1 microsecond"))


def week_slot(end: Column, minutes: int = 30) -> Column:
    """Half hours since Monday 00:00 of the interval's start."""
    start = end.cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    return F.weekday(start) * (1440 // minutes) + F.hour(start) * (60 // minutes) + F.floor(F.minute(start) / minutes)


def time_band(end: Column, minutes: int = 30) -> Column:
    hour = F.hour(end.cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes"))
    band = F.lit(BANDS[0][0])
    for name, first in BANDS[1:]:
        band = F.when(hour >= first, name).otherwise(band)
    return band


def latest_sunday(day: Column) -> Column:
    return F.date_sub(day, (F.weekday(day) + 1) % 7)
