"""Calendar columns and business-day rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/Toronto"


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def is_month_end(day: Column) -> Column:
    return day == F.last_day(day)


def calendar(day: Column) -> dict[str, Column]:
    """Calendar columns of the wide table. Flags follow the calendar, not business days."""
    month = F.month(day)
    return {
        "day_of_week": weekday(day),
        "day_of_month": F.dayofmonth(day),
        "week_of_year": F.weekofyear(day),
        "month": month,
        "quarter": F.quarter(day),
        "year": F.year(day),
        "is_month_start": F.dayofmonth(day) == 1,
        "is_month_end": is_month_end(day),
        "is_quarter_end": is_month_end(day) & (month % 3 == 0),
        "is_year_start": F.dayofyear(day) == 1,
        "is_year_end": (month == 12) & (F.dayofmonth(day) == 31),
    }


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def is_business_day(day: Column) -> Column:
    return weekday(day) < 5


def first_business_day(day: Column) -> Column:
    first = F.trunc(day, "month")
    return F.date_add(first, F.when(weekday(first) == 5, 2).when(weekday(first) == 6, 1).otherwise(0))


def last_business_day(day: Column) -> Column:
    last = F.last_day(day)
    return F.date_sub(last, F.when(weekday(last) == 5, 1).when(weekday(last) == 6, 2).otherwise(0))


def is_weekday_name(day: Column, name: Column) -> Column:
    """Does ``day`` fall on MON..FRI as named; unknown names never match."""
    number = F.array_position(F.array(*[F.lit(d) for d in ("MON", "TUE", "WED", "THU", "FRI")]), name)
    return weekday(day) == number - 1


def valid_date_text(text: Column) -> Column:
    """Text that is a real YYYY-MM-DD date."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def utc_instant(wall: Column) -> Column:
    """The ``timestamp`` of a UTC wall-clock time (``timestamp_ntz``), whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp")


def utc_wall(instant: Column) -> Column:
    """UTC wall-clock time (``timestamp_ntz``) of a ``timestamp``."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def local_date(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """Calendar date in ``zone`` of a UTC wall-clock time (``timestamp_ntz``)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def local_iso(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """ISO text with offset in ``zone`` of a UTC wall-clock time (``timestamp_ntz``)."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    sign = F.when(minutes < 0, "-").otherwise("+")
    hours = F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0")
    rest = F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, hours, F.lit(":"), rest)


def as_of_utc(text: Column) -> Column:
    """Served form of a run's time text: UTC with offset, a time without offset read as UTC.

    Text that is no time is passed on as it is.
    """
    with_offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    wall = F.when(with_offset, utc_wall(text.try_cast("timestamp"))).otherwise(text.try_cast("timestamp_ntz"))
    shown = F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.coalesce(shown, text)


def readable_date(day: Column) -> Column:
    return F.date_format(day, "MMMM dd, yyyy")
