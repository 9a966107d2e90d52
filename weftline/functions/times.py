"""Time as the reports need it: naive local times, floors of elapsed days, ISO weeks, mixed formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

#: Where a time can't be read (fixed value).
FAR_FUTURE = "2099-12-31 00:00:00"


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed days, floored; not the difference of calendar days."""
    return F.floor((micros(end) - micros(start)) / F.lit(float(DAY_US))).cast("long")


def local_text(epoch_ms: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(epoch_ms), zone), pattern)


def rezoned(c: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), c)


def week_start(c: Column) -> Column:
    return F.date_format(F.date_trunc("week", c), "yyyy-MM-dd")


def week_end(c: Column) -> Column:
    return F.date_format(F.date_add(F.date_trunc("week", c).cast("date"), 6), "yyyy-MM-dd")


def any_format(text: Column) -> Column:
    """Seconds (10 digits), milliseconds (13), ``Mon Jan 01 10:00:00 GMT+0800 2024`` (34 characters); else the far future."""
    n = F.length(text)
    month = "MMM dd HH:mm:ss 'GMT'Z yyyy"
    return F.coalesce(
        F.when(n == 10, F.timestamp_seconds(F.expr("try_cast(0 as bigint)") + text.try_cast("bigint"))),
        F.when(n == 13, F.timestamp_millis(text.try_cast("bigint"))),
        F.when(n == 34, F.try_to_timestamp(F.substring(text, 5, 100), F.lit(month))),
        F.to_timestamp(F.lit(FAR_FUTURE)),
    )


def shifted(c: Column, hours: Column | int) -> Column:
    """A wall clock some hours ahead, or behind; no summer time."""
    h = F.lit(hours) if isinstance(hours, int) else hours
    return c + F.make_dt_interval(hours=h.cast("int"))


def any_local_format(text: Column, hours: int) -> Column:
    """Seconds (10 digits) and milliseconds (13) moved by a country's hours, ``Mon Jan 01 10:00:00 GMT+08:00 2024`` (34 characters) as the moment it names; else the end of 2099."""
    n = F.length(text)
    moved = F.make_dt_interval(hours=F.lit(hours))
    return F.coalesce(
        F.when(n == 10, F.timestamp_seconds(text.try_cast("bigint")) + moved),
        F.when(n == 13, F.timestamp_seconds(F.floor(text.try_cast("bigint") / 1000)) + moved),
        F.when(n == 34, F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM dd HH:mm:ss 'GMT'XXX yyyy"))),
        F.to_timestamp(F.lit("2099-12-31 23:59:59")),
    )


def periods_back(reference: Column, n: int, days: int) -> Column:
    """n periods of ``days`` days before a date, the latest first: array of struct(start, end), both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.date_sub(reference, ((i + 1) * days).cast("int")).alias("start"), F.date_sub(reference, (i * days + 1).cast("int")).alias("end")))
