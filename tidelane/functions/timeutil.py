"""Clock, zone and duration columns. Instants are epoch microseconds (long); the session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
TIDE_WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
CURRENT_WEEKDAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def station_time_us(year: Column, month: Column, day: Column, hhmm: Column, offset_hours: Column) -> Column:
    """A station's clock reading as an instant; the offset is fixed for the year, with no shift of its own."""
    clock = F.split(hhmm, ":")
    minutes = F.unix_date(F.make_date(year, month, day)).cast("long") * 1440 + clock[0].cast("long") * 60 + clock[1].cast("long")
    return (minutes - offset_hours.cast("long") * 60) * MINUTE_US


def iso_minutes(t_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(t_us), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def signed_minutes(text: Column) -> Column:
    """``+HH:MM``, ``-HH:MM`` or ``HH:MM`` as minutes."""
    body = F.split(F.regexp_replace(text, "^[+-]", ""), ":")
    return F.when(F.startswith(text, F.lit("-")), -1).otherwise(1) * (body[0].cast("long") * 60 + body[1].cast("long"))


def weekday_label(date: Column, labels: tuple[str, ...] = TIDE_WEEKDAYS) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), F.weekday(date) + 1)


def local_midnight_us(t_us: Column, zone: str) -> Column:
    """The instant at which the local day of ``t_us`` began, whatever the zone's shifts."""
    day = F.date_trunc("day", F.from_utc_timestamp(F.timestamp_micros(t_us), zone))
    return F.unix_micros(F.to_utc_timestamp(day, zone))


def local_clock(t_us: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(t_us), zone), pattern)
