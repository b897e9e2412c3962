"""Constructions as tables of layers: find, raise, replace and cost them.

A construction is keyed by ``model_id, construction_id``. The number of layers
of one key is not assumed to be small: per-construction facts are aggregated
(combined before the shuffle) and joined back, never gathered into one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom import constants as K
from demandloom.functions.units import convert

KEYS = ("model_id", "construction_id")
# One ft2.h.R/Btu in SI: less than that is not taken for insulation.
MIN_R_SI = 1 / 5.678263341113488


def exterior_surfaces(surfaces: DataFrame, surface_type: str = "Wall") -> DataFrame:
    return surfaces.where((F.col("boundary") == "Outdoors") & (F.col("surface_type") == surface_type))


def construction_r(layers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Total resistance per construction, in SI and IP."""
    total = layers.groupBy(*keys).agg(
        F.sum("r_value").alias("r_si"), F.count(F.lit(1)).alias("n_layers")
    )
    return total.withColumn("r_ip", convert(F.col("r_si"), "m^2*K/W", "ft^2*h*R/Btu"))


def insulation_layer(
    layers: DataFrame, min_r: float = MIN_R_SI, considered: str = "all", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Layer with the largest resistance, the outermost of equals; ``layer_index`` tells the layers apart.

    ``considered="after_first"`` never picks the outermost layer nor counts its
    resistance; ``"above_first"`` also wants more than the resistance of the
    outermost layer. Both reproduce published results.
    """
    candidates, whole = layers, None
    if considered != "all":
        whole = layers.groupBy(*keys).agg(
            F.min("layer_index").alias("_first"), F.min_by("r_value", "layer_index").alias("_first_r")
        )
        usable = F.col("layer_index") > F.col("_first")
        if considered == "above_first":
            usable = usable & (F.col("r_value") > F.col("_first_r"))
        candidates = layers.join(whole, list(keys)).where(usable)
    # The largest of (resistance, place from the outside, facts of the layer) is the layer itself: one pass, one shuffle.
    facts = F.struct("r_value", (-F.col("layer_index")).alias("_inwards"), "layer_index", "material_id", "kind", "thickness")
    top = candidates.groupBy(*keys).agg(F.max(facts).alias("_top"))
    best = top.select(*keys, *(F.col(f"_top.{name}") for name in ("layer_index", "material_id", "kind", "thickness", "r_value")))
    if whole is not None:
        best = whole.select(*keys).join(best, list(keys), "left")
    return best.withColumn("found", F.coalesce(F.col("r_value") > F.lit(min_r), F.lit(False)))


def scale_layer(percent, compat: bool = False) -> dict[str, Column]:
    """New thickness and resistance after an increase by ``percent``.

    A massive layer gets thicker; other layers have no thickness to change and
    get the resistance itself. ``compat`` leaves those as they are.
    """
    factor = F.lit(1.0) + F.lit(float(percent)) / 100.0
    massive = F.col("kind") == "massive"
    return {
        "thickness": F.when(massive, F.col("thickness") * factor).otherwise(F.col("thickness")),
        "r_value": F.when(massive | F.lit(not compat), F.col("r_value") * factor).otherwise(F.col("r_value")),
    }


def raise_insulation(
    layers: DataFrame,
    surfaces: DataFrame,
    percent: float,
    surface_type: str = "Wall",
    label: str = "exterior wall insulation",
    considered: str = "all",
    compat: bool = False,
) -> DataFrame:
    """Layers of the adjusted copies of all constructions used on exterior surfaces.

    Constructions without an insulation layer have no copy. The layers are
    aggregated to one target per construction before anything is joined.
    """
    used = exterior_surfaces(surfaces, surface_type).select(*KEYS).distinct()
    targets = (
        insulation_layer(layers, considered=considered).where("found")
        .join(used, list(KEYS), "left_semi")
        .select(*KEYS, F.col("layer_index").alias("_target"))
    )
    changed = F.col("layer_index") == F.col("_target")
    scaled = {
        name: F.when(changed, new).otherwise(F.col(name))
        for name, new in scale_layer(percent, compat).items()
    }
    return (
        layers.join(targets, list(KEYS))
        .withColumns(
            {
                **scaled,
                "material_id": F.when(
                    changed, F.concat(F.col("material_id"), F.lit(f"_R-value {float(percent)}% increase"))
                ).otherwise(F.col("material_id")),
                "changed": changed,
                "new_construction_id": F.concat(F.col("construction_id").cast("string"), F.lit(f" adj {label}")),
            }
        )
        .drop("_target")
    )


def construction_map(raised: DataFrame) -> DataFrame:
    """Old and new id of each copied construction."""
    return raised.select(*KEYS, "new_construction_id").distinct()


def replace_on_surfaces(surfaces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Surfaces with their construction after the swap; defaulted ones follow their set."""
    hard = ~F.col("defaulted")
    return surfaces.join(mapping, list(KEYS), "left").withColumn(
        "new_construction_id",
        F.when(hard, F.coalesce("new_construction_id", F.col("construction_id").cast("string")))
        .otherwise(F.col("construction_id").cast("string")),
    )


def replace_in_sets(
    sets: DataFrame, mapping: DataFrame, slot: str = "wall", compat_slot: str | None = None
) -> DataFrame:
    """Construction sets in direct use, with ``slot`` moved to the new construction.

    ``compat_slot`` receives it instead, as one published variant did.
    """
    target = compat_slot or slot
    renamed = mapping.withColumnRenamed("construction_id", slot)
    return (
        sets.where(F.col("direct_use_count") > 0)
        .join(renamed, ["model_id", slot], "left")
        .withColumn(target, F.coalesce("new_construction_id", F.col(target).cast("string")))
        .drop("new_construction_id")
    )


def affected_area(surfaces: DataFrame, mapping: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Number of copied constructions and the area they cover, in SI and IP."""
    area = F.sum("net_area")
    return (
        surfaces.join(mapping, list(KEYS)).groupBy(*keys, "construction_id").agg(area.alias("net_area"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_constructions"), area.alias("area_si"))
        .withColumn("area_ip", convert(F.col("area_si"), "m^2", "ft^2"))
    )


def set_target_r(layers: DataFrame, target: Column) -> DataFrame:
    """Give a layer a resistance: by thickness where it has one."""
    massive = F.col("kind") == "massive"
    return layers.withColumns(
        {
            "thickness": F.when(
                massive, F.try_divide(F.col("thickness") * target, F.col("r_value"))
            ).otherwise(F.col("thickness")),
            "r_value": target,
            "material_id": F.concat(F.col("material_id"), F.lit(" - adj")),
        }
    )


def insert_layer(
    layers: DataFrame, properties: Mapping[str, Column], index: int = 0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add a layer at ``index`` of each construction; 0 is outside."""
    place = F.col("layer_index")
    moved = layers.withColumn("layer_index", F.when(place >= index, place + 1).otherwise(place))
    fresh = layers.select(*keys).distinct()
    values = {"layer_index": F.lit(index), **properties}
    added = fresh.select(
        *keys,
        *(
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in layers.schema.fields
            if f.name not in keys
        ),
    )
    return moved.unionByName(added)


def override_outside(
    layers: DataFrame, options: Mapping[str, float | None], only_outside: bool = True
) -> DataFrame:
    """Replace surface properties by the options that are given."""
    changed = F.col("layer_index") == 0 if only_outside else F.lit(True)
    edits = {
        name: F.when(changed, F.coalesce(F.lit(v).cast("double"), F.col(name))).otherwise(F.col(name))
        for name, v in options.items()
    }
    renamed = F.when(changed, F.concat(F.col("material_id"), F.lit(" - adj"))).otherwise(F.col("material_id"))
    return layers.withColumns({**edits, "material_id": renamed})


def construction_cost(
    costs: DataFrame, areas: DataFrame, keys: Sequence[str] = ("model_id",), category: str = "Construction"
) -> DataFrame:
    """Cost of the constructions that cover any area."""
    used = areas.where(F.col("net_area") > 0).select(*KEYS).distinct()
    return (
        costs.where(F.col("category") == category)
        .join(used, list(KEYS), "left_semi")
        .groupBy(*keys).agg(F.sum("total_cost").alias("cost"))
    )


def life_cycle_cost(
    costs: DataFrame, category: str = "Construction", only_year_zero: bool = True,
    keys: Sequence[str] = ("model_id",),
) -> DataFrame:
    wanted = F.col("category") == category
    if only_year_zero:
        wanted = wanted & (F.col("years_from_start") == 0)
    return costs.where(wanted).groupBy(*keys).agg(F.sum("total_cost").alias("cost"))


def set_slots() -> list[str]:
    surfaces = [f"{side}_{slot}" for side in ("exterior", "interior", "ground") for slot in K.SURFACE_SLOTS]
    subs = [f"{side}_{slot}" for side in ("exterior", "interior") for slot in K.SUB_SURFACE_SLOTS]
    return surfaces + subs + K.MISC_SLOTS


def list_constructions(sets: DataFrame, keys: Sequence[str] = ("model_id", "set_id")) -> DataFrame:
    """One row per filled slot of a construction set."""
    slots = [s for s in set_slots() if s in sets.columns]
    entries = [F.struct(F.lit(s).alias("slot"), F.col(s).cast("string").alias("construction_id")) for s in slots]
    return sets.select(*keys, F.inline(F.array(*entries))).where(F.col("construction_id").isNotNull())
