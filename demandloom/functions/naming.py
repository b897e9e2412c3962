"""Identifier formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_id(
    tstat: Column, start: Column, hours: Column,
    precool_hours: Column, precool: Column, reset: Column,
) -> Column:
    return F.concat_ws(
        "_", F.lit("DF"), *(c.cast("string") for c in (tstat, start, hours, precool_hours, precool, reset))
    )


def model_id(bldg_type: Column, vintage: Column, climate: Column) -> Column:
    return F.concat_ws("_", F.lit("model"), bldg_type, vintage, climate)


def last_token(value: Column, separator: str) -> Column:
    return F.element_at(F.split(value, separator), -1)


def seed_id(bldg_type: Column, template: Column, climate_zone: Column) -> Column:
    """Building type, last word of the template, last part of the climate zone."""
    return F.concat_ws("-", bldg_type, last_token(template, " "), last_token(climate_zone, "-"))


def instance_name(model: Column, case_no: Column, separator: str = "_") -> Column:
    return F.concat(model, F.lit(f"{separator}Inst_"), case_no.cast("string"))


def run_name(base_model: Column, event: Column) -> Column:
    return F.concat_ws("_", base_model, event)
