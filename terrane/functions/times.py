"""Times as column expressions: whole nanoseconds since 1970, GPS seconds, calendar parts, ranges.

Nanoseconds are longs, as Spark's timestamps hold microseconds only.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

GPS_EPOCH = 315964800
#: Seconds between the GPS epoch and the two missions' own epochs.
ALTIMETER_EPOCH = 1198800018
#: The days on which a leap second had been added since the GPS epoch.
LEAP_DAYS = (
    "1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01",
    "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01", "1996-01-01", "1997-07-01",
    "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
)
_LEAPS = tuple(int(datetime.fromisoformat(d).replace(tzinfo=UTC).timestamp()) for d in LEAP_DAYS)


def _leaps(second: Column, bounds: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for b in bounds:
        total = total + (second >= b).cast("int")
    return total


def gps_to_unix_ns(gps_seconds: Column) -> Column:
    """GPS seconds (double) to nanoseconds since 1970."""
    bounds = tuple(s - GPS_EPOCH + k for k, s in enumerate(_LEAPS))
    whole = F.floor(gps_seconds).cast("long")
    part = F.round((gps_seconds - whole) * 1_000_000_000).cast("long")
    return (whole + GPS_EPOCH - _leaps(whole, bounds)) * 1_000_000_000 + part


def unix_ns_to_gps_ms(ns: Column) -> Column:
    """Nanoseconds since 1970 to GPS milliseconds."""
    ms = F.floor(ns.cast("decimal(20,0)") / 1_000_000).cast("long")
    return ms - GPS_EPOCH * 1000 + _leaps(F.floor(ms / 1000), _LEAPS) * 1000


def mission_seconds_to_unix_ns(delta: Column, epoch: int = ALTIMETER_EPOCH) -> Column:
    """Seconds since a mission's epoch to nanoseconds since 1970."""
    return gps_to_unix_ns(delta + epoch)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp; sessions run in UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def timestamp(ns: Column) -> Column:
    return F.timestamp_micros(F.floor(ns.cast("decimal(20,0)") / 1000).cast("long"))


def gmt(ts: Column) -> Column:
    """Calendar parts: year, day of year, hour, minute, second, millisecond."""
    return F.struct(F.year(ts).alias("year"), F.dayofyear(ts).alias("doy"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"), F.floor(micros(ts) % 1_000_000 / 1000).cast("int").alias("millisecond"))


def cds_to_unix_ns(days: Column, ms: Column, epoch: str = "1958-01-01") -> Column:
    """Day-segmented packet time: days since the epoch and milliseconds of the day."""
    start = int(datetime.fromisoformat(epoch).replace(tzinfo=UTC).timestamp())
    return (days.cast("long") * 86400 + start) * 1_000_000_000 + ms.cast("long") * 1_000_000


def gmt_to_date(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1)


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def month_name(date: Column) -> Column:
    return F.date_format(date, "MMM")


def iso(ts: Column) -> Column:
    """ISO text in UTC with padded seconds and no trailing blank."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse(text: Column) -> Column:
    """ISO-like text to a timestamp; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", ""))


def between(ts: Column, t0: str | None, t1: str | None) -> Column:
    """Closed range; a missing bound is open."""
    out = F.lit(True)
    if t0 is not None:
        out = out & (ts >= F.to_timestamp_ntz(F.lit(t0)))
    if t1 is not None:
        out = out & (ts <= F.to_timestamp_ntz(F.lit(t1)))
    return out


def day_range(text: str) -> tuple[int, int, bool]:
    """First day, last day and whether days inside are wanted, of `a:b` or `!a:b`."""
    a, b = text.lstrip("!").split(":")
    return int(a), int(b), not text.startswith("!")


def in_day_range(ts: Column, text: str) -> Column:
    a, b, inside = day_range(text)
    hit = F.dayofyear(ts).between(a, b)
    return hit if inside else ~hit
