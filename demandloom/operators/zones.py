"""Zones, spaces, loads and equipment of many models at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def power_density(
    spaces: DataFrame, power: str, keys: Sequence[str] = ("model_id",), alias: str = "density"
) -> DataFrame:
    """Power over floor area, both times the space multiplier."""
    m = F.col("multiplier")
    return spaces.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(power) * m), F.sum(F.col("floor_area") * m)).alias(alias)
    )


def space_areas(
    spaces: DataFrame, area: str = "floor_area", keys: Sequence[str] = ("model_id",), space: str = "space_id"
) -> DataFrame:
    """Area per space and per model; ``area`` picks the column."""
    sized = spaces.select(*keys, space, (F.col(area) * F.col("multiplier")).alias("area"))
    totals = sized.groupBy(*keys).agg(F.sum("area").alias("total_area"))
    return sized.join(totals, list(keys))


def used_space_types(space_types: DataFrame, spaces: DataFrame) -> DataFrame:
    return space_types.join(spaces, ["model_id", "space_type"], "left_semi")


def space_type_standards(spaces: DataFrame, space_types: DataFrame) -> DataFrame:
    """Standards building and space type of each space; NULL where none is given."""
    info = space_types.select("model_id", "space_type", "standards_building", "standards_space_type")
    typed = spaces.where(F.col("space_type").isNotNull()).join(info, ["model_id", "space_type"], "left")
    # Spaces without a type would all meet in one task of the join.
    return typed.unionByName(spaces.where(F.col("space_type").isNull()), allowMissingColumns=True)


def untyped_zones(spaces: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones without a space, or with a space that has no type."""
    seen = spaces.groupBy("model_id", "zone_id").agg(F.bool_or(F.col("space_type").isNull()).alias("untyped"))
    return (
        zones.select("model_id", "zone_id").join(seen, ["model_id", "zone_id"], "left")
        .select(
            "model_id", "zone_id",
            F.when(F.col("untyped").isNull(), "no space").when(F.col("untyped"), "space without type").alias("problem"),
        )
        .where(F.col("problem").isNotNull())
    )


def classify_zones(
    zones: DataFrame, spaces: DataFrame, secondary_types: Sequence[str], plenum_type: str | None
) -> DataFrame:
    """Primary, secondary, plenum or unconditioned.

    ``zones``: ``has_thermostat, n_equipment``; ``spaces``: ``zone_id,
    space_type, standards_space_type``. One listed space decides for its zone.
    """
    plenum = F.lit(False) if plenum_type is None else F.col("space_type") == plenum_type
    facts = spaces.groupBy("model_id", "zone_id").agg(
        F.bool_or(F.coalesce(F.col("standards_space_type").isin(*secondary_types), F.lit(False))).alias("_secondary"),
        F.bool_or(F.coalesce(plenum, F.lit(False))).alias("_plenum"),
    )
    conditioned = F.col("has_thermostat") | (F.col("n_equipment") > 0)
    return zones.join(facts, ["model_id", "zone_id"], "left").select(
        "model_id", "zone_id",
        F.when(conditioned & F.coalesce("_secondary", F.lit(False)), "secondary")
        .when(conditioned, "primary")
        .when(F.coalesce("_plenum", F.lit(False)), "plenum")
        .otherwise("unconditioned").alias("zone_class"),
    )


def plenum_of_zones(surfaces: DataFrame, spaces: DataFrame, classes: DataFrame) -> DataFrame:
    """Plenum above each primary zone: the one with the largest shared floor.

    A plenum floor points at the surface below it, whose space gives the zone.
    """
    space_zone = spaces.select("model_id", "space_id", "zone_id")
    plenums = classes.where(F.col("zone_class") == "plenum").select("model_id", "zone_id")
    primary = classes.where(F.col("zone_class") == "primary").select("model_id", "zone_id")
    placed = surfaces.join(space_zone, ["model_id", "space_id"])
    floors = (
        placed.where((F.col("boundary") == "Surface") & (F.col("surface_type") == "Floor"))
        .join(plenums, ["model_id", "zone_id"], "left_semi")
        .select(
            "model_id", F.col("adjacent_surface_id").alias("surface_id"),
            F.col("zone_id").alias("plenum_zone_id"), "gross_area",
        )
    )
    below = placed.select("model_id", "surface_id", "zone_id").join(primary, ["model_id", "zone_id"], "left_semi")
    return (
        floors.join(below, ["model_id", "surface_id"])
        .groupBy("model_id", "zone_id")
        .agg(F.min(F.struct((-F.col("gross_area")).alias("a"), F.col("plenum_zone_id").alias("z"))).alias("_best"))
        .select(
            "model_id", "zone_id", F.col("_best.z").alias("plenum_zone_id"), (-F.col("_best.a")).alias("shared_area")
        )
    )


def equipment_counts(
    air_loops: DataFrame, plant_loops: DataFrame, equipment: DataFrame, keys: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Air loops, plant loops and zones with equipment other than an exhaust fan."""
    served = (
        equipment.groupBy(*keys, "zone_id")
        .agg(F.bool_or(F.col("equipment_type") != "exhaust_fan").alias("_served"))
        .groupBy(*keys).agg(F.count_if("_served").alias("n_zones"))
    )
    out = air_loops.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_air_loops"))
    out = out.join(plant_loops.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_plant_loops")), list(keys), "full")
    return out.join(served, list(keys), "full").na.fill(0)


def representative_loop(
    loop_zones: DataFrame, spaces: DataFrame, primary_type: str
) -> DataFrame:
    """Air loop serving the most spaces whose type name contains ``primary_type``."""
    matching = spaces.where(F.contains("space_type", F.lit(primary_type)))
    return (
        loop_zones.join(matching.select("model_id", "zone_id", "space_id"), ["model_id", "zone_id"])
        .groupBy("model_id", "air_loop").agg(F.count(F.lit(1)).alias("n_spaces"))
        .groupBy("model_id")
        .agg(F.min(F.struct((-F.col("n_spaces")).alias("n"), F.col("air_loop").alias("l"))).alias("_best"))
        .select("model_id", F.col("_best.l").alias("air_loop"), (-F.col("_best.n")).alias("n_spaces"))
    )


def exterior_lighting(lights: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    return lights.groupBy(*keys).agg(
        F.sum(F.col("design_level") * F.col("multiplier")).alias("exterior_lighting_power"),
        F.count(F.lit(1)).alias("n_lights"),
    )


def hard_assigned_schedules(loads: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """How often each schedule is assigned to a load directly."""
    return (
        loads.where(~F.col("defaulted") & F.col("schedule_id").isNotNull())
        .groupBy(*keys, "schedule_id").agg(F.count(F.lit(1)).alias("n_uses"))
    )


def lights_with_schedule(lights: DataFrame, schedules: DataFrame) -> DataFrame:
    """Lights of each space type with their schedule; none is reported.

    Lights without a schedule go around the join, where they would all meet.
    """
    known = schedules.select("model_id", "schedule_id", F.lit(True).alias("_known")).distinct()
    named = lights.where(F.col("schedule_id").isNotNull()).join(known, ["model_id", "schedule_id"], "left").withColumn(
        "status", F.when(F.col("_known"), "ok").otherwise("no schedule")
    ).drop("_known")
    return lights.where(F.col("schedule_id").isNull()).withColumn("status", F.lit("no schedule")).unionByName(named)


def climate_zone_number(zone: Column) -> Column:
    """First character when it is 1 to 8, else NULL."""
    first = F.substring(zone, 1, 1)
    return F.when(first.isin(*"12345678"), first)


def tip_texts(requests: DataFrame, tips: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Texts of the requested tips in order, joined by commas, and how many codes are unknown.

    Repeated codes count once, so a case holds at most as many as the tip table.
    """
    once = requests.groupBy(*keys, "guide", "code").agg(F.min("pos").alias("pos"))
    named = once.join(tips, ["guide", "code"], "left")
    found = F.when(F.col("text").isNotNull(), F.struct("pos", "text"))
    ordered = F.sort_array(F.collect_list(found))
    return named.groupBy(*keys, "guide").agg(
        F.array_join(F.transform(ordered, lambda t: t["text"]), ", ").alias("tips"),
        F.count_if(F.col("text").isNull()).alias("n_unknown"),
    )


def choices(df: DataFrame, name: str, handle: str) -> DataFrame:
    """Choice list: names in order with their handles."""
    return df.select(name, handle).distinct().orderBy(name, handle)


def preview(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows of an ordering."""
    return df.orderBy(*order).limit(rows)
