"""Calendar fields of zone-less timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMER_MONTHS = (5, 6, 7, 8, 9, 10)


def weekday(ts: Column) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(ts) - F.lit(1)


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def minute_stamp(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` of a zone-less timestamp, whatever the session zone is."""
    return F.substring(ts.cast("string"), 1, 16)


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    c = F.col(ts)
    return df.withColumns(
        {
            "year": F.year(c).cast("string"),
            "time": F.concat_ws(":", two_digits(F.hour(c)), two_digits(F.minute(c))),
            "month": F.month(c),
            "day": two_digits(F.dayofmonth(c)),
            "hour": F.hour(c),
            "minute": two_digits(F.minute(c)),
            "weekday": weekday(c),
        }
    )


def is_workday_in(ts: Column, months: Sequence[int] = SUMMER_MONTHS) -> Column:
    """Monday to Friday within ``months`` (default May to October)."""
    return weekday(ts).between(1, 5) & F.month(ts).isin(*months)


def select_workdays(df: DataFrame, months: Sequence[int] = SUMMER_MONTHS, ts: str = "ts") -> DataFrame:
    """Rows of workdays in ``months``.

    Functions of the time do not reach a file scan. Where the table has a
    ``month`` column, as the folders of a stored meter, it is asked as well, so
    that the other months are not read.
    """
    wanted = is_workday_in(F.col(ts), months)
    if "month" in df.columns:
        wanted = F.col("month").isin(*months) & wanted
    return df.where(wanted)


def day_key(ts: Column, kind: str = "calendar_day") -> Column:
    """Key of a day.

    ``calendar_day`` is one key per date. ``year_dom`` leaves the month out, so
    equal days of all months share a key, for comparison with older results.
    """
    if kind == "calendar_day":
        return F.to_date(ts).cast("string")
    if kind == "year_dom":
        return F.concat_ws("-", F.year(ts).cast("string"), two_digits(F.dayofmonth(ts)))
    raise ValueError(f"unknown day key {kind!r}")


def interval_start(start: str, step_no: Column, step_minutes: int) -> Column:
    """Timestamp of an ordinal step, never taken from file order."""
    return F.timestamp_add(
        "MINUTE",
        (step_no * F.lit(step_minutes)).cast("int"),
        F.lit(start).cast("timestamp_ntz"),
    )
