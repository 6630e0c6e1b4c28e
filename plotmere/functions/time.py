"""Civil time as columns. Timestamps are taken as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zone whose calendar counts.
ZONE = "America/Denver"


def civil(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def civil_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(civil(ts, zone))


def clock_text(ts: Column, zone: str = ZONE) -> Column:
    """ "Sep 29, 2026, 10:14 AM"."""
    return F.date_format(civil(ts, zone), "MMM d, yyyy, h:mm a")


def day_clock_text(ts: Column, now: Column, zone: str = ZONE) -> Column:
    """ "today at 10:14 AM", "tomorrow at 8:00 AM", else "Oct 2 at 9:05 AM"."""
    days = F.datediff(civil_day(ts, zone), civil_day(now, zone))
    day = F.when(days == 0, "today").when(days == 1, "tomorrow").otherwise(F.date_format(civil(ts, zone), "MMM d"))
    return F.concat(day, F.lit(" at "), F.date_format(civil(ts, zone), "h:mm a"))


def month_start(ts: Column, zone: str = ZONE) -> Column:
    return F.trunc(civil_day(ts, zone), "month")


def excel_serial(ts: Column, offset_seconds: int = 0) -> Column:
    return F.lit(25569.0) + (F.unix_seconds(ts.cast("timestamp")) + offset_seconds) / F.lit(86400.0)


def work_hours(ts: Column, zone: str = ZONE) -> Column:
    """A weekday between 07:20 and 19:00."""
    local = civil(ts, zone)
    minutes = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) < 5) & (minutes >= 7 * 60 + 20) & (minutes < 19 * 60)
