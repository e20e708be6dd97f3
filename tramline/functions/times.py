"""Times as transit feeds write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.ids import as_column


def gtfs_seconds(c: Column | str) -> Column:
    """Seconds of a service day of H:MM:SS, where hours may pass 24; -1 for anything else."""
    t = F.trim(as_column(c))
    part = lambda k: F.regexp_extract(t, r"^(\d+):(\d{1,2}):(\d{1,2})$", k).try_cast("int")
    h, m, s = part(1), part(2), part(3)
    return F.when((m <= 59) & (s <= 59), h * 3600 + m * 60 + s).otherwise(F.lit(-1))


def gtfs_date(c: Column | str) -> Column:
    """Date of YYYYMMDD; null for anything else."""
    return F.when(as_column(c).rlike(r"^\d{8}$"), F.try_to_date(as_column(c), "yyyyMMdd"))


def lenient_int(c: Column | str, fallback: int) -> Column:
    return F.coalesce(F.trim(as_column(c)).try_cast("int"), F.lit(fallback))


def lenient_double(c: Column | str, fallback: float) -> Column:
    return F.coalesce(F.trim(as_column(c)).try_cast("double"), F.lit(fallback))


def lenient_instant(c: Column | str) -> Column:
    """ISO time with or without zone (none means UTC), or epoch milliseconds; blank or rubbish is null."""
    t = F.trim(as_column(c))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), F.try_to_timestamp(t))
    return F.coalesce(iso, F.timestamp_millis(F.when(t.rlike(r"^-?\d{1,15}$"), t.try_cast("bigint"))))


def local(c: Column | str, zone: str) -> Column:
    """Wall-clock time in `zone` of a UTC time."""
    return F.from_utc_timestamp(as_column(c).cast("timestamp"), zone)


def second_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def runs_on(date: Column, days: Column, start: Column, end: Column) -> Column:
    """Whether a weekly service with weekdays `days` (0 = Monday) runs on a date of its validity."""
    return date.between(start, end) & F.array_contains(days, F.weekday(date))


def day_set(*flags: Column | str) -> Column:
    """Weekdays (0 = Monday) whose flag is "1"."""
    return F.array_compact(F.array(*[F.when(F.trim(as_column(f)) == "1", F.lit(k)) for k, f in enumerate(flags)]))
