"""Times of day, sessions and vendor time texts. Timestamps are without zone and in Tokyo time unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import padded

#: The day session, in seconds of the day: from 08:45:00 to before 15:45:00.
DAY_FROM, DAY_TO = 31_500, 56_700
#: Minutes of the day at which the sessions open.
DAY_OPEN, NIGHT_OPEN = 525, 1020


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def session_type(ts: Column) -> Column:
    """DAY or NIGHT; a null time is NIGHT."""
    return F.when(seconds_of_day(ts).between(DAY_FROM, DAY_TO - 1), "DAY").otherwise("NIGHT")


def iso_weekday(d: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(d) + 1


def session_date(ts: Column) -> Column:
    """The trade date of a quote: from 16:00 the next weekday's, before that the calendar's, Saturdays too."""
    date, days = F.to_date(ts), F.when(iso_weekday(ts) == 5, 3).when(iso_weekday(ts) == 6, 2).otherwise(1)
    return F.when(F.hour(ts) >= 16, F.date_add(date, days)).otherwise(date)


def bar_start(ts: Column, width: str = "30 seconds") -> Column:
    return F.window(ts, width)["start"]


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def minutes_from_open(ts: Column, kind: Column) -> Column:
    """Minutes since the session's opening; after midnight the night goes on counting."""
    m = minute_of_day(ts)
    night = F.when(m >= NIGHT_OPEN, m - NIGHT_OPEN).otherwise(m + (1440 - NIGHT_OPEN))
    return F.when(kind == "DAY", m - DAY_OPEN).otherwise(night)


def week_start(ts: Column) -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", ts))


def vendor_timestamp(date: Column, time: Column) -> Column:
    """From yyyyMMdd and HHmmssSSS, numbers or texts; null if they aren't a time."""
    parts = r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d{3})$"
    iso = F.regexp_replace(F.concat(padded(date, 8), padded(time, 9)), parts, "$1-$2-$3 $4:$5:$6.$7")
    return iso.try_cast("timestamp_ntz")


def vendor_date(date: Column) -> Column:
    """From yyyyMMdd; null if it isn't a date."""
    return F.regexp_replace(padded(date, 8), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3").try_cast("date")


def tokyo_time(ts: Column, zone: str = "EET") -> Column:
    """Broker time to Tokyo time. Times in a clock change's gap shift silently."""
    return F.convert_timezone(F.lit(zone), F.lit("Asia/Tokyo"), ts)
