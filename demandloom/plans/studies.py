"""The end-to-end studies, each one lazy pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from demandloom.functions.calendar import SUMMER_MONTHS, select_workdays
from demandloom.operators import metrics
from demandloom.sources.stored_pairs import StoredPairs


def shed_intervals(
    baseline: DataFrame, scenario: DataFrame, link: DataFrame, months: Sequence[int] = SUMMER_MONTHS
) -> DataFrame:
    """Shed per interval on workdays of ``months``.

    Both sides carry the time, so both are cut down before they meet.
    """
    paired = metrics.pair_with_baseline(
        select_workdays(baseline, months), select_workdays(scenario, months), link
    )
    return metrics.add_shed(paired)


def shed_intervals_stored(spark: SparkSession, pairs: StoredPairs, months: Sequence[int] = SUMMER_MONTHS) -> DataFrame:
    """The same from tables that :func:`write_pairs` has stored; their rows stay where they are."""
    baseline, scenario = (select_workdays(pairs.table(spark, kind), months) for kind in ("baseline", "scenario"))
    return metrics.add_shed(metrics.pair_stored(baseline, scenario, pairs.link(spark)))


def shed_hourly(
    baseline: DataFrame, scenario: DataFrame, link: DataFrame, months: Sequence[int] = SUMMER_MONTHS
) -> DataFrame:
    """Hourly means of the interval columns."""
    return metrics.binned_shed(select_workdays(baseline, months), select_workdays(scenario, months), link)


def shed_box_study(baseline, scenario, link, months=SUMMER_MONTHS, day: str = "calendar_day") -> DataFrame:
    hourly = shed_hourly(baseline, scenario, link, months)
    return metrics.box_stats(metrics.day_hour_cells(hourly, day=day))


def shed_fit_study(
    baseline, scenario, link, months=SUMMER_MONTHS, breakpoint: float = 75.0
) -> DataFrame:
    return metrics.piecewise_fit(shed_hourly(baseline, scenario, link, months), breakpoint=breakpoint)
