"""Queries over construction layers and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandloom.functions.units import neat_number, neat_with_unit, solar_reflectance_index
from demandloom.operators import envelope
from demandloom.plans import inputs
from demandloom.plans.registry import query

LAYER_SQL = """
lay AS (
  SELECT l_orderkey % 10 AS model_id, l_orderkey AS construction_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag) - 1 AS INTEGER) AS layer_index,
         'mat' || l_partkey AS material_id,
         CASE l_returnflag WHEN 'A' THEN 'massive' WHEN 'N' THEN 'massless' ELSE 'airgap' END AS kind,
         (l_partkey % 20 + 1) / 100e0 AS thickness, l_quantity / 10 AS r_value,
         l_discount + 0.5e0 AS solar_abs, l_tax + 0.8e0 AS thermal_abs
  FROM lineitem)"""

SURFACE_SQL = """
surf AS (
  SELECT o_custkey % 10 AS model_id, o_orderkey AS surface_id, o_custkey AS construction_id,
         CASE o_orderstatus WHEN 'F' THEN 'Wall' WHEN 'O' THEN 'RoofCeiling' ELSE 'Floor' END AS surface_type,
         CASE WHEN o_orderpriority < '4' THEN 'Outdoors' ELSE 'Ground' END AS boundary,
         o_orderpriority = '1-URGENT' AS defaulted, o_totalprice / 100 AS net_area FROM orders)"""


def layers(spark, sf_dir):
    """Order as construction, each of its lines as a layer, quantity as resistance."""
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    flag = F.col("l_returnflag")
    return inputs.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 10).alias("model_id"),
        F.col("l_orderkey").alias("construction_id"),
        (F.row_number().over(order) - 1).alias("layer_index"),
        F.concat(F.lit("mat"), F.col("l_partkey").cast("string")).alias("material_id"),
        F.when(flag == "A", "massive").when(flag == "N", "massless").otherwise("airgap").alias("kind"),
        ((F.col("l_partkey") % 20 + 1) / 100.0).alias("thickness"),
        (F.col("l_quantity") / 10).alias("r_value"),
        (F.col("l_discount") + 0.5).alias("solar_abs"),
        (F.col("l_tax") + 0.8).alias("thermal_abs"),
    )


def surfaces(spark, sf_dir):
    status = F.col("o_orderstatus")
    return inputs.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).alias("model_id"),
        F.col("o_orderkey").alias("surface_id"),
        F.col("o_custkey").alias("construction_id"),
        F.when(status == "F", "Wall").when(status == "O", "RoofCeiling").otherwise("Floor").alias("surface_type"),
        F.when(F.col("o_orderpriority") < "4", "Outdoors").otherwise("Ground").alias("boundary"),
        (F.col("o_orderpriority") == "1-URGENT").alias("defaulted"),
        (F.col("o_totalprice") / 100).alias("net_area"),
    )


def rounded(df, **digits):
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


@query(
    "construction_r",
    f"WITH {LAYER_SQL} SELECT model_id, construction_id, round(sum(r_value), 6) AS r_si, count(*) AS n_layers, "
    "round(sum(r_value) * 5.678263341113488e0, 6) AS r_ip FROM lay GROUP BY 1, 2",
)
def construction_r(spark, sf_dir):
    return rounded(envelope.construction_r(layers(spark, sf_dir)), r_si=6, r_ip=6)


PICK_SQL = """
SELECT model_id, construction_id, layer_index, material_id, kind, thickness, r_value, r_value > {min_r} AS found
FROM (SELECT *, row_number() OVER (PARTITION BY model_id, construction_id ORDER BY r_value DESC, layer_index) AS rn FROM {src})
WHERE rn = 1"""


@query("insulation_layer", f"WITH {LAYER_SQL} {PICK_SQL.format(src='lay', min_r='1 / 5.678263341113488e0')}")
def insulation_layer(spark, sf_dir):
    return envelope.insulation_layer(layers(spark, sf_dir))


@query(
    "insulation_layer_above_first",
    f"WITH {LAYER_SQL}, later AS (SELECT l.* FROM lay l JOIN (SELECT model_id, construction_id, min(layer_index) AS i0, "
    "arg_min(r_value, layer_index) AS r0 FROM lay GROUP BY 1, 2) f USING (model_id, construction_id) "
    f"WHERE layer_index > i0 AND r_value > r0) {PICK_SQL.format(src='later', min_r='2.0e0')}",
)
def insulation_layer_above_first(spark, sf_dir):
    found = envelope.insulation_layer(layers(spark, sf_dir), min_r=2.0, considered="above_first")
    return found.where(F.col("layer_index").isNotNull())


def raised_sql(surface_type: str, percent: float, label: str, raises_r: str = "true") -> str:
    return f"""{LAYER_SQL}, {SURFACE_SQL},
best AS ({PICK_SQL.format(src='lay', min_r='1 / 5.678263341113488e0')}),
target AS (SELECT model_id, construction_id, layer_index AS t FROM best WHERE found AND (model_id, construction_id) IN
  (SELECT (model_id, construction_id) FROM surf WHERE surface_type = '{surface_type}' AND boundary = 'Outdoors')),
raised AS (SELECT model_id, construction_id, layer_index,
  CASE WHEN layer_index = t THEN material_id || '_R-value {percent}% increase' ELSE material_id END AS material_id,
  CASE WHEN layer_index = t AND kind = 'massive' THEN thickness * (1 + {percent}e0 / 100) ELSE thickness END AS thickness,
  CASE WHEN layer_index = t AND {raises_r} THEN r_value * (1 + {percent}e0 / 100) ELSE r_value END AS r_value,
  construction_id || ' adj {label}' AS new_construction_id
  FROM lay JOIN target USING (model_id, construction_id))"""


def raised_walls(spark, sf_dir):
    return envelope.raise_insulation(layers(spark, sf_dir), surfaces(spark, sf_dir), 45)


RAISED_OUT = (
    "model_id, construction_id, layer_index, material_id, round(thickness, 6) AS thickness, "
    "round(r_value, 6) AS r_value, new_construction_id FROM raised"
)
RAISED_COLUMNS = [
    "model_id", "construction_id", "layer_index", "material_id", "thickness", "r_value", "new_construction_id"
]


@query(
    "raise_insulation",
    f"WITH {raised_sql('Wall', 45.0, 'exterior wall insulation')} SELECT {RAISED_OUT}",
)
def raise_insulation(spark, sf_dir):
    return rounded(raised_walls(spark, sf_dir).select(*RAISED_COLUMNS), thickness=6, r_value=6)


@query(
    "raise_roof_insulation",
    f"WITH {raised_sql('RoofCeiling', 30.0, 'roof insulation')} SELECT {RAISED_OUT}",
)
def raise_roof_insulation(spark, sf_dir):
    raised = envelope.raise_insulation(
        layers(spark, sf_dir), surfaces(spark, sf_dir), 30, "RoofCeiling", "roof insulation"
    )
    return rounded(raised.select(*RAISED_COLUMNS), thickness=6, r_value=6)


@query(
    "raise_insulation_by_thickness_only",
    f"""WITH {raised_sql('Wall', 45.0, 'exterior wall insulation', "kind = 'massive'")} SELECT {RAISED_OUT}""",
)
def raise_insulation_by_thickness_only(spark, sf_dir):
    raised = envelope.raise_insulation(layers(spark, sf_dir), surfaces(spark, sf_dir), 45, compat=True)
    return rounded(raised.select(*RAISED_COLUMNS), thickness=6, r_value=6)


@query(
    "replaced_surfaces",
    f"WITH {raised_sql('Wall', 45.0, 'exterior wall insulation')}, "
    "m AS (SELECT DISTINCT model_id, construction_id, new_construction_id FROM raised) "
    "SELECT surface_id, CASE WHEN NOT defaulted AND m.new_construction_id IS NOT NULL THEN m.new_construction_id "
    "ELSE CAST(s.construction_id AS VARCHAR) END AS new_construction_id "
    "FROM surf s LEFT JOIN m USING (model_id, construction_id)",
)
def replaced_surfaces(spark, sf_dir):
    mapping = envelope.construction_map(raised_walls(spark, sf_dir))
    return envelope.replace_on_surfaces(surfaces(spark, sf_dir), mapping).select("surface_id", "new_construction_id")


def construction_sets(spark, sf_dir):
    key = F.col("c_custkey")
    return inputs.table(spark, sf_dir, "customer").select(
        (key % 10).alias("model_id"), key.alias("set_id"),
        (F.col("c_nationkey") % 3).alias("direct_use_count"), key.alias("wall"),
    )


@query(
    "replaced_sets",
    f"WITH {raised_sql('Wall', 45.0, 'exterior wall insulation')}, "
    "m AS (SELECT DISTINCT construction_id, new_construction_id FROM raised) "
    "SELECT c_custkey AS set_id, coalesce(new_construction_id, CAST(c_custkey AS VARCHAR)) AS wall "
    "FROM customer LEFT JOIN m ON construction_id = c_custkey WHERE c_nationkey % 3 > 0",
)
def replaced_sets(spark, sf_dir):
    mapping = envelope.construction_map(raised_walls(spark, sf_dir))
    return envelope.replace_in_sets(construction_sets(spark, sf_dir), mapping).select("set_id", "wall")


@query(
    "affected_area",
    f"WITH {raised_sql('Wall', 45.0, 'exterior wall insulation')} "
    "SELECT model_id, count(DISTINCT construction_id) AS n_constructions, round(sum(net_area), 4) AS area_si, "
    "round(sum(net_area) / (0.3048e0 * 0.3048e0), 3) AS area_ip FROM surf WHERE surface_type = 'Wall' "
    "AND boundary = 'Outdoors' AND construction_id IN (SELECT construction_id FROM raised) GROUP BY 1",
)
def affected_area(spark, sf_dir):
    mapping = envelope.construction_map(raised_walls(spark, sf_dir))
    walls = envelope.exterior_surfaces(surfaces(spark, sf_dir))
    return rounded(envelope.affected_area(walls, mapping), area_si=4, area_ip=3)


@query(
    "target_r",
    f"WITH {LAYER_SQL} SELECT construction_id, layer_index, material_id || ' - adj' AS material_id, "
    "round(CASE WHEN kind = 'massive' THEN thickness * 2.5e0 / nullif(r_value, 0) ELSE thickness END, 6) AS thickness, "
    "2.5e0 AS r_value FROM lay",
)
def target_r(spark, sf_dir):
    changed = envelope.set_target_r(layers(spark, sf_dir), F.lit(2.5))
    return rounded(
        changed.select("construction_id", "layer_index", "material_id", "thickness", "r_value"), thickness=6
    )


@query(
    "inserted_layer",
    f"WITH {LAYER_SQL} SELECT construction_id, layer_index + 1 AS layer_index, material_id, thickness FROM lay "
    "UNION ALL SELECT DISTINCT construction_id, 0, 'new material', 0.02e0 FROM lay",
)
def inserted_layer(spark, sf_dir):
    grown = envelope.insert_layer(
        layers(spark, sf_dir), {"material_id": F.lit("new material"), "thickness": F.lit(0.02)}
    )
    return grown.select("construction_id", "layer_index", "material_id", "thickness")


@query(
    "surface_properties",
    f"WITH {LAYER_SQL} SELECT construction_id, layer_index, "
    "CASE WHEN layer_index = 0 THEN material_id || ' - adj' ELSE material_id END AS material_id, "
    "round(CASE WHEN layer_index = 0 THEN 0.35e0 ELSE solar_abs END, 6) AS solar_abs, "
    "round(thermal_abs, 6) AS thermal_abs FROM lay",
)
def surface_properties(spark, sf_dir):
    changed = envelope.override_outside(layers(spark, sf_dir), {"solar_abs": 0.35, "thermal_abs": None})
    columns = ["construction_id", "layer_index", "material_id", "solar_abs", "thermal_abs"]
    return rounded(changed.select(*columns), solar_abs=6, thermal_abs=6)


@query(
    "reflectance_index",
    f"WITH {LAYER_SQL}, x AS (SELECT construction_id, (20.797e0 * solar_abs - 0.603e0 * thermal_abs) / "
    "(9.5205e0 * thermal_abs + 12.0e0) AS x FROM lay WHERE layer_index = 0) "
    "SELECT construction_id, round(123.97e0 - 141.35e0 * x + 9.6555e0 * x * x, 5) AS sri FROM x",
)
def reflectance_index(spark, sf_dir):
    outside = layers(spark, sf_dir).where(F.col("layer_index") == 0)
    sri = solar_reflectance_index(F.col("solar_abs"), F.col("thermal_abs"))
    return outside.select("construction_id", F.round(sri, 5).alias("sri"))


def costs(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 10).alias("model_id"),
        F.col("l_orderkey").alias("construction_id"),
        F.when(F.col("l_returnflag") == "A", "Construction").otherwise("Maintenance").alias("category"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("years_from_start"),
        F.col("l_extendedprice").alias("total_cost"),
    )


@query(
    "cost_year0",
    "SELECT l_orderkey % 10 AS model_id, round(sum(l_extendedprice), 2) AS cost FROM lineitem "
    "WHERE l_returnflag = 'A' AND l_linestatus = 'O' GROUP BY 1",
)
def cost_year0(spark, sf_dir):
    return rounded(envelope.life_cycle_cost(costs(spark, sf_dir)), cost=2)


@query(
    "construction_cost",
    f"WITH {SURFACE_SQL} SELECT l_orderkey % 10 AS model_id, round(sum(l_extendedprice), 2) AS cost FROM lineitem "
    "WHERE l_returnflag = 'A' AND l_orderkey IN (SELECT construction_id FROM surf WHERE net_area > 1000) GROUP BY 1",
)
def construction_cost(spark, sf_dir):
    areas = surfaces(spark, sf_dir).withColumn("net_area", F.greatest(F.col("net_area") - 1000, F.lit(0.0)))
    return rounded(envelope.construction_cost(costs(spark, sf_dir), areas), cost=2)


@query(
    "construction_listing",
    """SELECT c_custkey AS set_id, slot, CAST(id AS VARCHAR) AS construction_id FROM customer, LATERAL (VALUES
('exterior_wall', c_custkey), ('interior_floor', CASE WHEN c_nationkey % 2 = 0 THEN c_custkey + 1 END),
('exterior_skylight', c_custkey + 2), ('site_shading', CASE WHEN c_acctbal > 0 THEN c_custkey + 3 END)) v(slot, id)
WHERE id IS NOT NULL""",
)
def construction_listing(spark, sf_dir):
    key = F.col("c_custkey")
    sets = inputs.table(spark, sf_dir, "customer").select(
        key.alias("set_id"),
        key.alias("exterior_wall"),
        F.when(F.col("c_nationkey") % 2 == 0, key + 1).alias("interior_floor"),
        (key + 2).alias("exterior_skylight"),
        F.when(F.col("c_acctbal") > 0, key + 3).alias("site_shading"),
    )
    return envelope.list_constructions(sets, ["set_id"])


@query(
    "number_display",
    """SELECT o_orderkey, printf('%,.2f', round(o_totalprice, 2)) AS plain, printf('%,.0f', round(o_totalprice)) AS whole,
'(ft^2) ' || printf('%,.1f', round(o_totalprice / (0.3048e0 * 0.3048e0), 1)) AS with_unit FROM orders""",
)
def number_display(spark, sf_dir):
    price = F.col("o_totalprice")
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        neat_number(price, 2).alias("plain"),
        neat_number(price, 0).alias("whole"),
        neat_with_unit(price, "m^2", "ft^2", 1, unit_before=True, unit_after=False).alias("with_unit"),
    )


@query(
    "unit_conversions",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 1.8e0 + 32, 6) AS fahrenheit,
round(l_quantity / 0.3048e0, 6) AS feet, round(l_extendedprice / (0.3048e0 * 0.3048e0), 4) AS square_feet,
round(l_quantity / 5.678263341113488e0, 6) AS r_si, round(degrees(l_quantity), 6) AS degrees FROM lineitem""",
)
def unit_conversions(spark, sf_dir):
    from demandloom.functions.units import convert

    quantity = F.col("l_quantity")
    return inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(convert(quantity, "C", "F"), 6).alias("fahrenheit"),
        F.round(convert(quantity, "m", "ft"), 6).alias("feet"),
        F.round(convert(F.col("l_extendedprice"), "m^2", "ft^2"), 4).alias("square_feet"),
        F.round(convert(quantity, "ft^2*h*R/Btu", "m^2*K/W"), 6).alias("r_si"),
        F.round(convert(quantity, "rad", "deg"), 6).alias("degrees"),
    )
