"""Checks that give one status row per design row.

``status`` is ok, warning, error or not_applicable; ``messages`` lists the reasons.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom import constants as K
from demandloom.session import fixed_table


def finding(when: Column, level: str, text: str | Column) -> Column:
    """A (level, message) where the condition holds, else NULL."""
    message = F.lit(text) if isinstance(text, str) else text
    return F.when(when, F.struct(F.lit(level).alias("level"), message.alias("message")))


def first_of(*findings: Column) -> Column:
    """Only the first finding that applies."""
    return F.coalesce(*findings)


def with_status(df: DataFrame, *findings: Column) -> DataFrame:
    """Add ``status`` and ``messages``; information does not change the status."""
    found = F.filter(F.array(*findings), lambda f: f.isNotNull())

    def has(level: str) -> Column:
        return F.exists("_found", lambda f: f["level"] == level)

    return (
        df.withColumn("_found", found)
        .withColumn(
            "status",
            F.when(has("error"), "error").when(has("not_applicable"), "not_applicable")
            .when(has("warning"), "warning").otherwise("ok"),
        )
        .withColumn("messages", F.transform("_found", lambda f: f["message"]))
        .drop("_found")
    )


def _setpoint_delta(name: str, costly: Column) -> Column:
    size = F.abs(F.col(name))
    return first_of(
        finding(costly, "warning", f"{name}: energy use will rise"),
        finding(size > 500, "error", f"{name}: far beyond a usual setpoint change"),
        finding(size > 50, "warning", f"{name}: larger than a usual setpoint change"),
    )


def check_setpoint_deltas(df: DataFrame, cooling: str = "cooling", heating: str = "heating") -> DataFrame:
    """A lower cooling or higher heating setpoint is only warned about, whatever its size."""
    return with_status(
        df, _setpoint_delta(cooling, F.col(cooling) < 0), _setpoint_delta(heating, F.col(heating) > 0)
    )


def check_event_window(df: DataFrame, compat: bool = False) -> DataFrame:
    """Hours, minutes and order of ``start_hour, start_minute, end_hour, end_minute``.

    ``compat`` compares hours and minutes each on their own.
    """
    sh, sm, eh, em = (F.col(c) for c in ("start_hour", "start_minute", "end_hour", "end_minute"))
    if compat:
        order = [
            finding(eh < sh, "error", "end hour before start hour"),
            finding(em < sm, "error", "end minute before start minute"),
        ]
    else:
        order = [finding(eh * 60 + em < sh * 60 + sm, "error", "end before start")]
    fields = [
        finding(~F.col(c).between(0, top), "error", f"{c} out of range")
        for c, top in (("start_hour", 23), ("start_minute", 59), ("end_hour", 23), ("end_minute", 59))
    ]
    return with_status(df, *fields, *order)


def _percent(name: str) -> Column:
    p = F.col(name)
    return first_of(
        finding(p > 100, "error", f"{name}: more than 100 percent"),
        finding(p == 0, "info", f"{name}: no change asked for"),
        finding(F.abs(p) < 1, "warning", f"{name}: very low"),
        finding(p > 90, "warning", f"{name}: very high"),
        finding(p < 0, "info", f"{name}: negative, power will rise"),
    )


def check_lighting(
    df: DataFrame, percents: Sequence[str], start_min: str = "start_min", end_min: str = "end_min"
) -> DataFrame:
    """Reduction percentages and the time window of a lighting change."""
    window = finding(F.col(start_min) > F.col(end_min), "error", "end before start")
    return with_status(df, *(_percent(p) for p in percents), window)


def check_insulation(df: DataFrame, percent: str = "percent") -> DataFrame:
    """``n_surfaces`` exterior surfaces found, ``area`` altered."""
    return with_status(
        df,
        finding(F.col(percent) < -100, "error", "decrease of more than 100 percent"),
        first_of(
            finding(F.col("n_surfaces") == 0, "not_applicable", "no exterior surface"),
            finding(F.coalesce("area", F.lit(0.0)) == 0, "not_applicable", "nothing altered"),
        ),
    )


def check_ranges(arguments: DataFrame, rules: DataFrame) -> DataFrame:
    """Arguments in long form against ``param, low, high, low_inclusive, high_inclusive, default_value``.

    The default stands in for a missing value; a value that is no number is an
    error. An argument without a rule is ok.
    """
    given = F.col("value").try_cast("double")
    v = F.when(F.col("value").isNull(), F.col("default_value")).otherwise(given)
    too_low = F.when(F.col("low_inclusive"), v < F.col("low")).otherwise(v <= F.col("low"))
    too_high = F.when(F.col("high_inclusive"), v > F.col("high")).otherwise(v >= F.col("high"))
    return with_status(
        arguments.join(rules.withColumn("_ruled", F.lit(True)), "param", "left"),
        finding(
            F.col("_ruled") & F.col("value").isNotNull() & given.isNull(), "error", F.concat(F.col("param"), F.lit(" is no number"))
        ),
        finding(F.coalesce(too_low, F.lit(False)), "error", F.concat(F.col("param"), F.lit(" too low"))),
        finding(F.coalesce(too_high, F.lit(False)), "error", F.concat(F.col("param"), F.lit(" too high"))),
    ).drop("_ruled")


def choice_table(spark) -> DataFrame:
    lists = {
        "reporting_frequency": K.REPORTING_FREQUENCIES, "building_type": K.PROTOTYPE_TYPES,
        "template": K.PROTOTYPE_TEMPLATES, "climate_zone": K.PROTOTYPE_CLIMATES,
    }
    rows = [(param, value) for param, values in lists.items() for value in values]
    return fixed_table(spark, rows, "param string, value string")


def not_a_choice(arguments: DataFrame, choices: DataFrame) -> DataFrame:
    """Long-form arguments whose value is not among the choices of their parameter."""
    return arguments.join(choices, ["param", "value"], "left_anti")


def clean_output_requests(requests: DataFrame, name: str = "variable_name") -> DataFrame:
    """Blank keys become ``*``; a request without name or frequency is an error."""
    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""

    cleaned = requests.withColumn("_blank_key", blank("key"))
    cleaned = cleaned.withColumn("key", F.when(F.col("_blank_key"), "*").otherwise(F.col("key")))
    return with_status(
        cleaned,
        finding(blank(name), "error", "no name"),
        finding(blank("reporting_frequency"), "error", "no reporting frequency"),
        finding(F.col("_blank_key"), "info", "blank key changed to *"),
    ).drop("_blank_key")


def resolve_choices(
    chosen: DataFrame, objects: DataFrame, handle: str = "handle", building: str | None = None
) -> DataFrame:
    """Find the chosen object of each row; the whole building may be chosen instead."""
    known = objects.select("model_id", handle, F.lit(True).alias("_known")).distinct()
    whole = F.lit(False) if building is None else F.coalesce(F.col(handle) == building, F.lit(False))
    joined = chosen.join(known, ["model_id", handle], "left").withColumn("apply_to_building", whole)
    missing = F.col("_known").isNull() & ~F.col("apply_to_building")
    return with_status(
        joined,
        first_of(
            finding(missing & (F.coalesce(F.col(handle), F.lit("")) == ""), "error", "nothing was chosen"),
            finding(missing, "error", "the choice was not found"),
        ),
    ).drop("_known")


def check_hours_of_operation(df: DataFrame) -> DataFrame:
    """Length of the hours of operation after a change, from ``start, finish, delta_length``."""
    base = F.when(F.col("start") <= F.col("finish"), F.col("finish") - F.col("start")).otherwise(
        F.col("finish") - F.col("start") + 24
    )
    length = base + F.col("delta_length")
    return with_status(
        df.withColumn("new_length", length),
        finding(F.col("new_length") < 0, "error", "less than no hours of operation"),
        finding(F.col("new_length") > 24, "error", "more than 24 hours of operation"),
    )


def typed_arguments(df: DataFrame, types: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Cast text arguments to their declared type and fill defaults.

    A value that is there but cannot be cast is an error and stays NULL.
    """
    casts, problems = {}, []
    for name, (kind, default) in types.items():
        cast = F.col(name).try_cast(kind)
        casts[name] = F.when(F.col(name).isNull(), F.lit(default).cast(kind)).otherwise(cast)
        bad = F.col(name).isNotNull() & cast.isNull()
        problems.append(finding(bad, "error", f"{name} is not of type {kind}"))
    return with_status(df, *problems).withColumns(casts)


def change_report(old: DataFrame, new: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Old and new value of each parameter per model, in long form; NULL where a model is on one side only."""
    before = old.select(*keys, *(F.col(c).cast("string").alias("_old_" + c) for c in columns))
    after = new.select(*keys, *(F.col(c).cast("string").alias("_new_" + c) for c in columns))
    entries = [
        F.struct(
            F.lit(c).alias("param"), F.col("_old_" + c).alias("old_value"), F.col("_new_" + c).alias("new_value")
        )
        for c in columns
    ]
    return before.join(after, list(keys), "full").select(*keys, F.inline(F.array(*entries)))
