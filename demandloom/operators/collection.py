"""From long report rows to one wide row per interval."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.constants import OUTPUT_SPEC

Spec = Mapping[str, tuple[str | None, str, str]]


def wanted(key: str | None, name: str, frequency: str) -> Column:
    test = (F.col("name") == name) & (F.col("reporting_frequency") == frequency)
    return test if key is None else test & (F.col("key_value") == key)


def filter_report(report: DataFrame, spec: Spec = OUTPUT_SPEC) -> DataFrame:
    """Rows asked for by ``spec``. The list of names is stated on its own as
    well, because a plain IN reaches the file scan."""
    any_of = None
    for rule in spec.values():
        any_of = wanted(*rule) if any_of is None else any_of | wanted(*rule)
    names = sorted({rule[1] for rule in spec.values()})
    return report.where(F.col("name").isin(*names) & any_of)


def report_to_wide(
    report: DataFrame, spec: Spec = OUTPUT_SPEC, keys: tuple[str, ...] = ("run_id", "step_no")
) -> DataFrame:
    """One column per requested output, in one aggregation."""
    return (
        filter_report(report, spec)
        .groupBy(*keys)
        .agg(*(F.max(F.when(wanted(*rule), F.col("value"))).alias(out) for out, rule in spec.items()))
    )
