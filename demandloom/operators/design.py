"""Parametric designs: grids, codes, lookups and baseline matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom import constants as K
from demandloom.functions.naming import case_id, model_id
from demandloom.operators.pairing import pair_all


def _choices(values: Sequence[int]):
    return F.explode(F.array(*(F.lit(int(v)) for v in values)))


def event_grid(
    models: DataFrame,
    tstats: Sequence[int] = K.HVAC_TSTAT,
    starts: Sequence[int] = K.EVENT_START,
    hours: Sequence[int] = K.EVENT_HOURS,
    precool_hours: Sequence[int] = K.PRECOOL_HOURS,
    precool_degs: Sequence[int] = K.PRECOOL_DEG,
    reset_degs: Sequence[int] = K.RESET_DEG,
    compat: bool = False,
) -> DataFrame:
    """All admissible events for each row of ``models``.

    The six parameter lists are short arguments, so the grid unfolds from each
    model row where that row is: no join and no shuffle. Each constraint stands
    right after its last parameter, which keeps rejected branches from growing.
    ``compat`` writes the whole pre-cool list into the id, which makes ids repeat.
    """
    grid = (
        models.withColumn("hvac_tstat", _choices(tstats))
        .withColumn("event_start", _choices(starts))
        .withColumn("event_hours", _choices(hours))
        .where(F.col("event_start") + F.col("event_hours") <= K.LATEST_END)
        .withColumn("precool_hours", _choices(precool_hours))
        .withColumn("precool_deg", _choices(precool_degs))
        .where(F.col("hvac_tstat") - F.col("precool_deg") >= K.COOLEST_PRECOOL)
        .withColumn("reset_deg", _choices(reset_degs))
        .where(F.col("hvac_tstat") + F.col("reset_deg") <= K.WARMEST_RESET)
    )
    shown = F.lit(str(list(precool_hours))) if compat else F.col("precool_hours")
    return grid.withColumn(
        "case_id",
        case_id(
            F.col("hvac_tstat"), F.col("event_start"), F.col("event_hours"), shown,
            F.col("precool_deg"), F.col("reset_deg"),
        ),
    )


def model_grid(types: DataFrame, vintages: DataFrame, climates: DataFrame) -> DataFrame:
    """Every type x vintage x climate, from three one-column tables."""
    grid = pair_all(pair_all(types, vintages), climates)
    return grid.withColumn(
        "model_id", model_id(F.col("bldg_type"), F.col("bldg_vintage"), F.col("climate"))
    )


def encode(df: DataFrame, codes: Mapping[str, Mapping] = K.CODES) -> DataFrame:
    """Ordinal code of each coded column; NULL where the value has none.

    The maps are a handful of literals, so they live in the expression.
    """
    out = {}
    for name, mapping in codes.items():
        if name in df.columns:
            flat = [F.lit(x) for value, code in mapping.items() for x in (str(value), code)]
            out[name + "_code"] = F.try_element_at(F.create_map(*flat), F.col(name).cast("string"))
    return df.withColumns(out)


BASELINE_KEYS = ("model_id", "hvac_tstat", "event_start", "event_hours")


def match_baseline(
    cases: DataFrame,
    keys: Sequence[str] = BASELINE_KEYS,
    case: str = "case_id",
    precool: str = "precool_deg",
    reset: str = "reset_deg",
) -> DataFrame:
    """The baseline of each case: same keys, no pre-cooling and no reset.

    Baselines are first reduced to one row per key, so a key shared by very
    many cases costs one row on that side of the join.
    """
    baselines = (
        cases.where((F.col(precool) == 0) & (F.col(reset) == 0))
        .groupBy(*keys)
        .agg(F.min(case).alias("baseline_id"))
    )
    return cases.join(baselines, list(keys), "left")


def design_long(design: DataFrame, case_no: str = "case_no") -> DataFrame:
    """One row per case and parameter, with the column position."""
    params = [c for c in design.columns if c != case_no]
    entries = [
        F.struct(
            F.lit(i).alias("param_pos"), F.lit(p).alias("param"), F.col(p).cast("string").alias("value")
        )
        for i, p in enumerate(params)
    ]
    return design.select(case_no, F.inline(F.array(*entries)))


def join_lookup(long: DataFrame, lookup: DataFrame) -> DataFrame:
    """Parameters with their measure description; ``error`` names a parameter that has none."""
    described = long.join(lookup.withColumn("_described", F.lit(True)), "param", "left")
    error = F.when(F.col("_described").isNull(), F.concat(F.lit("no description for "), F.col("param")))
    return described.withColumn("error", error).drop("_described")


def missing_params(long: DataFrame, lookup: DataFrame) -> DataFrame:
    """Parameters without a description, with the number of cases; empty when all is well."""
    return (
        long.groupBy("param").agg(F.count(F.lit(1)).alias("n_cases")).join(lookup, "param", "left_anti")
    )
