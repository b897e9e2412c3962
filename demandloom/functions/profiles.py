"""Day profiles as arrays of ``(until_min, value)``.

A profile is a step function over the day: value ``i`` holds on
``(until[i-1], until[i]]`` and the last breakpoint is 1440. A day has at most
1440 whole minutes, so such an array has a fixed upper size and every edit
below is a narrow, shuffle-free column expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
Edit = Callable[[Column], Column]


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def point(until_min: Column, value: Column) -> Column:
    return F.struct(
        until_min.cast("int").alias("until_min"), value.cast("double").alias("value")
    )


def value_at(points: Column, minute) -> Column:
    """Value in force at a minute: that of the first breakpoint not before it."""
    minute = as_col(minute)
    later = F.filter(points, lambda p: p["until_min"] >= minute)
    return F.coalesce(F.get(later, 0)["value"], F.try_element_at(points, F.lit(-1))["value"])


def map_values(points: Column, edit: Edit) -> Column:
    return F.transform(points, lambda p: point(p["until_min"], edit(p["value"])))


def canonical(points: Column) -> Column:
    """The same step function without needless breakpoints: those with the value of the next one go."""
    last = F.size(points) - 1
    needed = F.filter(points, lambda p, i: (i == last) | ~F.get(points, i + 1)["value"].eqNullSafe(p["value"]))
    return F.transform(needed, lambda p: point(p["until_min"], p["value"] + F.lit(0.0)))  # -0.0 is 0.0


def edit_window(points: Column, start, end, inside: Edit, outside: Edit | None = None) -> Column:
    """Apply ``inside`` on ``(start, end]`` and ``outside`` elsewhere.

    Each segment is cut into its parts before, in and after the window, in one
    pass over the array; an empty window leaves the values as they are.
    """
    start = as_col(start)
    end = F.greatest(start, as_col(end))
    outside = outside or (lambda v: v)

    def cut(p: Column, i: Column) -> Column:
        begin, until, v = F.coalesce(F.get(points, i - 1)["until_min"], F.lit(0)), p["until_min"], p["value"]

        def part(low: Column, high: Column, value: Column) -> Column:
            return F.when(low < high, point(high, value))

        return F.array(
            part(begin, F.least(until, start), outside(v)),
            part(F.greatest(begin, start), F.least(until, end), inside(v)),
            part(F.greatest(begin, end), until, outside(v)),
        )

    return F.filter(F.flatten(F.transform(points, cut)), lambda p: p.isNotNull())


def adjust(kind: str, amount) -> Edit:
    """Value edit of one of the kinds Multiplier, Sum or Replace; NULL changes nothing."""
    amount = as_col(amount)
    edits = {
        "Multiplier": lambda v: v * F.coalesce(amount, F.lit(1.0)),
        "Sum": lambda v: v + F.coalesce(amount, F.lit(0.0)),
        "Replace": lambda v: F.coalesce(amount, v),
    }
    edits["Percentage"], edits["Value"] = edits["Multiplier"], edits["Sum"]
    if kind not in edits:
        raise ValueError(f"unknown adjustment {kind!r}")
    return edits[kind]


def rate_of_change(points: Column) -> Column:
    """Absolute change per hour at each breakpoint; the first has none before it."""

    def rate(p: Column, i: Column) -> Column:
        before = F.get(points, i - 1)
        hours = (p["until_min"] - before["until_min"]) / 60.0
        return point(
            p["until_min"],
            F.coalesce(F.try_divide(F.abs(p["value"] - before["value"]), hours), F.lit(0.0)),
        )

    return F.transform(points, rate)


def sample(points: Column, every_min: int, include_midnight: bool = True) -> Column:
    """Values at equal spacing through the day, the first one step after midnight."""
    last = DAY if include_midnight else DAY - every_min
    return F.transform(
        F.sequence(F.lit(every_min), F.lit(last), F.lit(every_min)),
        lambda t: value_at(points, t),
    )


def thin(points: Column, gap_min: float = 1.0) -> Column:
    """Drop each breakpoint that is no more than ``gap_min`` after the last kept one."""

    def keep(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = last.isNotNull() & (p["until_min"] - last["until_min"] <= gap_min)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(points, F.slice(points, 1, 0), keep)


def from_hour_pairs(pairs: Column) -> Column:
    """Profile of an array of ``(hour, value)`` with decimal hours."""
    from demandloom.functions.timeparse import decimal_hour_to_minutes

    return F.array_sort(
        F.transform(pairs, lambda p: point(decimal_hour_to_minutes(p["hour"]), p["value"]))
    )


def from_hour_map(pairs: Column) -> Column:
    """Profile of a map from decimal hour to value."""
    from demandloom.functions.timeparse import decimal_hour_to_minutes

    return F.array_sort(
        F.transform(
            F.map_entries(pairs), lambda e: point(decimal_hour_to_minutes(e["key"]), e["value"])
        )
    )


def _whole_minutes(hours: Column) -> Column:
    """Minutes of a decimal hour, cut off towards zero."""
    whole = hours.cast("int")
    return (whole * 60 + ((hours - whole) * 60).cast("int")).cast("double")


def moved_hours(points: Column, start, finish, delta_length, shift) -> Column:
    """Breakpoints at their new places as sorted ``(until_min, pos, value)``.

    ``start``/``finish`` are the present hours of operation, ``delta_length`` the
    change of their length and ``shift`` a move of the whole day, all in decimal
    hours. Open hours stretch around their middle, closed hours around theirs;
    what passes midnight comes in at the other end. Times are rounded to seconds.
    """
    start_h, finish_h, delta_h, shift_h = (
        as_col(v).cast("double") for v in (start, finish, delta_length, shift)
    )
    day = float(DAY)
    open_at, close_at = _whole_minutes(start_h), _whole_minutes(finish_h)
    daytime = start_h <= finish_h

    base_h = F.when(daytime, finish_h - start_h).otherwise(finish_h - start_h + 24)
    new_h = base_h + delta_h
    open_rate = F.try_divide(new_h, base_h)
    closed_rate = F.try_divide(24 - new_h, 24 - base_h)

    half = F.abs(close_at - open_at) / 2
    near_middle = F.least(open_at, close_at) + half
    far_middle = near_middle + day / 2
    mid_open = F.when(daytime, near_middle).otherwise(far_middle)
    mid_closed = F.when(~daytime, near_middle).when(far_middle > day, far_middle - day).otherwise(far_middle)
    # One running clock from opening through closing to the middle of the closed hours.
    close_run = F.when(close_at < mid_open, close_at + day).otherwise(close_at)
    mid_closed_run = F.when(mid_closed < close_run, mid_closed + day).otherwise(mid_closed)

    def place(minute: Column) -> Column:
        run = F.when(minute < open_at, minute + day).otherwise(minute)
        stretch = (
            F.when(run <= close_run, (run - mid_open) * (open_rate - 1))
            .otherwise((run - mid_closed_run) * (closed_rate - 1))
        )
        moved = minute + _whole_minutes(shift_h) + stretch
        wrapped = F.when(moved < 0, moved + day).when(moved > day, moved - day).otherwise(moved)
        return F.round(wrapped * 60) / 60

    return F.array_sort(
        F.transform(
            _trim_when_always_open(points, new_h == 24, open_at, close_at),
            lambda p, i: F.struct(
                place(p["until_min"]).alias("until_min"), i.alias("pos"), p["value"].alias("value")
            ),
        )
    )


def without_overlaps(moved: Column) -> Column:
    """Where several moved points fall together the last of the old day counts."""
    return F.filter(
        moved,
        lambda p, i: F.coalesce(F.get(moved, i + 1)["until_min"] != p["until_min"], F.lit(True)),
    )


def close_day(moved: Column) -> Column:
    """Profile of moved points, ending at 24:00 and thinned to more than a minute.

    The first segment of the new day began before midnight, so it also ends the
    day, unless a point lies on 24:00 itself.
    """
    day = float(DAY)
    at_midnight = F.get(F.filter(moved, lambda p: p["until_min"] == day), 0)["value"]
    before_midnight = F.transform(
        F.filter(moved, lambda p: p["until_min"] < day),
        lambda p: F.struct(p["until_min"].alias("until_min"), p["value"].alias("value")),
    )
    midnight = F.struct(
        F.lit(day).alias("until_min"),
        F.coalesce(at_midnight, F.get(moved, 0)["value"]).alias("value"),
    )
    return thin(F.concat(before_midnight, F.array(midnight)), 1.0)


def _trim_when_always_open(points: Column, always: Column, open_at: Column, close_at: Column) -> Column:
    """With 24 open hours nothing of the closed hours may be stretched."""
    open_value, close_value = value_at(points, open_at), value_at(points, close_at)
    first, last = F.get(points, 0)["value"], F.try_element_at(points, F.lit(-1))["value"]
    daytime = open_at < close_at
    kept = F.filter(
        points,
        lambda p: F.when(daytime, (p["until_min"] > open_at) & (p["until_min"] < close_at))
        .otherwise(((p["until_min"] > open_at) | (p["until_min"] < close_at)) & (p["until_min"] < DAY)),
    )
    midnight = F.when(daytime, F.greatest(open_value, close_value)).otherwise(F.greatest(first, last))
    trimmed = F.array_sort(
        F.concat(
            kept,
            F.array(point(open_at, open_value), point(close_at, close_value), point(F.lit(DAY), midnight)),
        )
    )
    return F.when(always, trimmed).otherwise(points)


def setback_profile(start, end, fraction) -> Column:
    """Exterior-light profile with a set-back between two decimal hours."""
    from demandloom.functions.timeparse import decimal_hour_to_minutes

    start, end, fraction = (as_col(v).cast("double") for v in (start, end, fraction))
    start_min, end_min = decimal_hour_to_minutes(start), decimal_hour_to_minutes(end)
    full, midnight = F.lit(1.0), F.lit(DAY)
    return (
        F.when((start == 24) | (start == 0), F.array(point(end_min, fraction), point(midnight, full)))
        .when(
            start > end,
            F.array(point(end_min, fraction), point(start_min, full), point(midnight, fraction)),
        )
        .otherwise(F.array(point(start_min, full), point(end_min, fraction)))
    )
