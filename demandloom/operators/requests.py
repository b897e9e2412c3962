"""Output requests and run results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# --- fixed values: the reporting schedule that is made where a request names it ---
THREE_DAYS_PER_MONTH = "reporting_schedule_3_days_per_month"


def match_reporting_schedule(
    requests: DataFrame, schedules: DataFrame, keys: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Requests with ``added``: false where a named reporting schedule does not exist in the model.

    :data:`THREE_DAYS_PER_MONTH` always exists, its days are those of
    ``schedule.reporting_calendar``. Requests without a schedule, the common
    case, go around the join, where they would all meet.
    """
    name = F.col("reporting_schedule")
    needs_none = F.coalesce(name == THREE_DAYS_PER_MONTH, F.lit(True))
    known = schedules.select(*keys, F.col("name").alias("reporting_schedule"), F.lit(True).alias("_known")).distinct()
    named = requests.where(~needs_none).join(known, [*keys, "reporting_schedule"], "left")
    named = named.withColumn("added", F.coalesce("_known", F.lit(False))).drop("_known")
    return requests.where(needs_none).withColumn("added", F.lit(True)).unionByName(named)


def request_counts(matched: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    return matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_requested"), F.count_if("added").alias("n_added")
    )


def upsert_meters(
    existing: DataFrame, requested: DataFrame, keys: Sequence[str] = ("model_id", "name"), order: str | None = None
) -> DataFrame:
    """Meters after the requests: an existing name only changes its frequency.

    Of several requests for one meter the last by ``order`` counts.
    """
    last = F.max_by("reporting_frequency", order) if order else F.max("reporting_frequency")
    wanted = requested.groupBy(*keys).agg(last.alias("_wanted"))
    return existing.withColumn("_there", F.lit(True)).join(wanted, list(keys), "full").select(
        *keys,
        F.coalesce("_wanted", "reporting_frequency").alias("reporting_frequency"),
        F.when(F.col("_there").isNull(), "added")
        .when(F.col("_wanted").isNull() | F.col("_wanted").eqNullSafe(F.col("reporting_frequency")), "kept")
        .otherwise("changed").alias("action"),
    )


def first_step_with(values: DataFrame, argument: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Value and measure of the first step that carries an argument (``step_pos, measure, name, value``)."""
    return (
        values.where(F.col("name") == argument)
        .groupBy(*keys)
        .agg(F.min(F.struct("step_pos", "measure", "value")).alias("_first"))
        .select(*keys, "_first.step_pos", "_first.measure", "_first.value")
    )
