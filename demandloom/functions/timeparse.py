"""Times, dates and weekday lists given as text or decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandloom.constants import WEEKDAYS


def decimal_hour_to_minutes(hour: Column) -> Column:
    """Minutes of day of a decimal hour; part minutes are cut off."""
    whole = F.floor(hour)
    return (whole * 60 + F.floor((hour - whole) * 60)).cast("int")


def hhmm_to_minutes(text: Column) -> Column:
    """Minutes of day of ``hhmm``."""
    return F.substring(text, 1, 2).cast("int") * 60 + F.substring(text, 3, 2).cast("int")


def month_day(text: Column, year: int) -> Column:
    parts = F.split(text, "/")
    return F.make_date(F.lit(year), parts[0].cast("int"), parts[1].cast("int"))


def date_range(text: Column, year: int) -> tuple[Column, Column]:
    """First and last date of ``m/d-m/d``."""
    ends = F.split(text, "-")
    return month_day(ends[0], year), month_day(ends[1], year)


def weekday_flags(text: Column) -> Column:
    """Seven booleans, Sunday first, of a list such as ``Mon/Tue``."""
    named = F.split(text, "/")
    return F.array(*(F.array_contains(named, day) for day in WEEKDAYS))
