"""Unit conversion and number display as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_AREA_FACTOR = 1 / 0.3048**2

# (from, to) -> (factor, offset): y = x * factor + offset
UNITS: dict[tuple[str, str], tuple[float, float]] = {
    ("C", "F"): (1.8, 32.0),
    ("m", "ft"): (1 / 0.3048, 0.0),
    ("m^2", "ft^2"): (FLOOR_AREA_FACTOR, 0.0),
    ("m^2*K/W", "ft^2*h*R/Btu"): (5.678263341113488, 0.0),
    ("W/m^2*K", "Btu/ft^2*h*R"): (1 / 5.678263341113488, 0.0),
    ("rad", "deg"): (180.0 / math.pi, 0.0),
}


def factor_and_offset(source: str, target: str) -> tuple[float, float]:
    if source == target:
        return 1.0, 0.0
    if (source, target) in UNITS:
        return UNITS[(source, target)]
    if (target, source) in UNITS:
        factor, offset = UNITS[(target, source)]
        return 1 / factor, -offset / factor
    raise ValueError(f"no conversion from {source} to {target}")


def convert(value: Column, source: str, target: str) -> Column:
    factor, offset = factor_and_offset(source, target)
    return value * F.lit(factor) + F.lit(offset)


def celsius_to_fahrenheit(value: Column) -> Column:
    return convert(value, "C", "F")


def joules_to_kw(value: Column, interval_s: int = 900) -> Column:
    """Mean power over an interval from the energy used in it."""
    return value / F.lit(interval_s * 1000.0)


def solar_reflectance_index(solar_abs: Column, thermal_abs: Column) -> Column:
    from demandloom.constants import SRI_DENOMINATOR, SRI_NUMERATOR, SRI_POLYNOMIAL

    x = F.try_divide(
        solar_abs * SRI_NUMERATOR[0] + thermal_abs * SRI_NUMERATOR[1],
        thermal_abs * SRI_DENOMINATOR[0] + SRI_DENOMINATOR[1],
    )
    return F.lit(SRI_POLYNOMIAL[0]) + x * SRI_POLYNOMIAL[1] + x * x * SRI_POLYNOMIAL[2]


def neat_number(value: Column, digits: int = 2) -> Column:
    """``4125001.25641`` -> ``4,125,001.26`` (or ``4,125,001`` with no digits)."""
    return F.format_number(F.round(value, digits), digits)


def neat_with_unit(
    value: Column,
    source: str,
    target: str,
    digits: int = 2,
    unit_before: bool = False,
    unit_after: bool = True,
    space: bool = True,
    parentheses: bool = True,
) -> Column:
    """Converted number with its unit before and/or after it."""
    label = f"({target})" if parentheses else target
    gap = " " if space else ""
    parts = [neat_number(convert(value, source, target), digits)]
    if unit_before:
        parts.insert(0, F.lit(label + gap))
    if unit_after:
        parts.append(F.lit(gap + label))
    return F.concat(*parts)
