"""Envelope, geometry and zones on buildings small enough to work out by hand."""

import math

import pytest

from demandloom.functions import units
from demandloom.operators import envelope, geometry, zones
from pyspark.sql import functions as F

LAYER = (
    "model_id string, construction_id string, layer_index int, material_id string, kind string, "
    "thickness double, r_value double, solar_abs double, thermal_abs double"
)


def wall(spark, *resistances, kind="massive"):
    rows = [("m", "c", i, f"mat{i}", kind, 0.1, r, 0.7, 0.9) for i, r in enumerate(resistances)]
    return spark.createDataFrame(rows, LAYER)


def outside(spark, surface_type="Wall", boundary="Outdoors", defaulted=False):
    return spark.createDataFrame(
        [("m", "s1", "c", surface_type, boundary, defaulted, 20.0)],
        "model_id string, surface_id string, construction_id string, surface_type string, boundary string, "
        "defaulted boolean, net_area double",
    )


def test_insulation_is_the_outermost_of_equals(spark):
    row = envelope.insulation_layer(wall(spark, 0.2, 2.0, 2.0)).first()
    assert (row.layer_index, row.material_id, row.found) == (1, "mat1", True)
    assert not envelope.insulation_layer(wall(spark, 0.1, 0.17)).first().found


def test_insulation_compat_never_takes_the_first_layer(spark):
    layers = wall(spark, 5.0, 0.1, 2.0)
    assert envelope.insulation_layer(layers).first().layer_index == 0
    assert envelope.insulation_layer(layers, considered="after_first").first().layer_index == 2
    above = envelope.insulation_layer(layers, considered="above_first").first()
    assert above.layer_index is None and not above.found


def test_raised_insulation(spark):
    raised = {r.layer_index: r for r in envelope.raise_insulation(wall(spark, 0.2, 2.0), outside(spark), 50).collect()}
    assert raised[1].thickness == pytest.approx(0.15) and raised[1].r_value == pytest.approx(3.0)
    assert raised[1].material_id == "mat1_R-value 50.0% increase"
    assert (raised[0].thickness, raised[0].r_value, raised[0].material_id) == (0.1, 0.2, "mat0")
    assert raised[0].new_construction_id == "c adj exterior wall insulation"


@pytest.mark.parametrize("compat,r", [(False, 3.0), (True, 2.0)])
def test_layers_without_thickness(spark, compat, r):
    layers = wall(spark, 0.2, 2.0, kind="massless")
    raised = envelope.raise_insulation(layers, outside(spark), 50, compat=compat).where("layer_index = 1").first()
    assert raised.thickness == 0.1 and raised.r_value == pytest.approx(r)


def test_only_exterior_surfaces_of_the_type_count(spark):
    layers = wall(spark, 0.2, 2.0)
    assert envelope.raise_insulation(layers, outside(spark, boundary="Ground"), 50).count() == 0
    assert envelope.raise_insulation(layers, outside(spark, "RoofCeiling"), 50).count() == 0
    assert envelope.raise_insulation(layers, outside(spark, "RoofCeiling"), 50, "RoofCeiling").count() == 2


def test_swap_on_surfaces_and_sets(spark):
    mapping = envelope.construction_map(envelope.raise_insulation(wall(spark, 0.2, 2.0), outside(spark), 50))
    hard = envelope.replace_on_surfaces(outside(spark), mapping).first()
    soft = envelope.replace_on_surfaces(outside(spark, defaulted=True), mapping).first()
    assert hard.new_construction_id.startswith("c adj") and soft.new_construction_id == "c"
    sets = spark.createDataFrame(
        [("m", "used", 1, "c", "roof"), ("m", "idle", 0, "c", "roof")],
        "model_id string, set_id string, direct_use_count int, wall string, roof string",
    )
    right = envelope.replace_in_sets(sets, mapping).collect()
    assert [(r.set_id, r.wall[:5], r.roof) for r in right] == [("used", "c adj", "roof")]
    compat = envelope.replace_in_sets(sets, mapping, compat_slot="roof").first()
    assert compat.wall == "c" and compat.roof.startswith("c adj")
    area = envelope.affected_area(outside(spark), mapping).first()
    assert (area.n_constructions, area.area_si) == (1, 20.0)
    assert area.area_ip == pytest.approx(215.278, abs=1e-3)


def test_target_r_and_new_layer(spark):
    massive = envelope.set_target_r(wall(spark, 2.0), F.lit(5.0)).first()
    assert (massive.thickness, massive.r_value) == (pytest.approx(0.25), 5.0)
    massless = envelope.set_target_r(wall(spark, 2.0, kind="airgap"), F.lit(5.0)).first()
    assert (massless.thickness, massless.r_value) == (0.1, 5.0)
    grown = envelope.insert_layer(wall(spark, 1.0, 2.0), {"material_id": F.lit("new")}, index=1)
    assert [r.material_id for r in grown.orderBy("layer_index").collect()] == ["mat0", "new", "mat1"]


def test_surface_properties_change_outside_only(spark):
    changed = envelope.override_outside(wall(spark, 1.0, 2.0), {"solar_abs": 0.3, "thermal_abs": None})
    got = {r.layer_index: (r.solar_abs, r.thermal_abs, r.material_id) for r in changed.collect()}
    assert got == {0: (0.3, 0.9, "mat0 - adj"), 1: (0.7, 0.9, "mat1")}


def test_reflectance_of_a_white_and_a_black_roof(spark):
    row = spark.range(1).select(
        units.solar_reflectance_index(F.lit(0.2), F.lit(0.9)), units.solar_reflectance_index(F.lit(0.95), F.lit(0.9))
    ).first()
    assert row[0] == pytest.approx(100, abs=1) and row[1] == pytest.approx(0, abs=2)


def test_costs(spark):
    costs = spark.createDataFrame(
        [("m", "c", "Construction", 0, 10.0), ("m", "c", "Construction", 5, 7.0), ("m", "d", "Construction", 0, 1.0),
         ("m", "c", "Maintenance", 0, 100.0)],
        "model_id string, construction_id string, category string, years_from_start int, total_cost double",
    )
    assert envelope.life_cycle_cost(costs).first().cost == 11.0
    assert envelope.life_cycle_cost(costs, only_year_zero=False).first().cost == 18.0
    assert envelope.construction_cost(costs, outside(spark)).first().cost == 17.0


def test_slots_of_a_construction_set(spark):
    assert len(envelope.set_slots()) == 29
    sets = spark.createDataFrame(
        [("m", "s", "w", None)], "model_id string, set_id string, exterior_wall string, interior_floor string"
    )
    assert [r.slot for r in envelope.list_constructions(sets).collect()] == ["exterior_wall"]


def test_units_and_display(spark):
    row = spark.range(1).select(
        units.neat_number(F.lit(4125001.25641)), units.neat_number(F.lit(4125001.25641), 0),
        units.neat_with_unit(F.lit(1.0), "m", "ft", 2), units.neat_with_unit(F.lit(0.0), "C", "F", 1, True, False),
        units.convert(F.lit(212.0), "F", "C"),
    ).first()
    assert tuple(row)[:4] == ("4,125,001.26", "4,125,001", "3.28 (ft)", "(F) 32.0")
    assert row[4] == pytest.approx(100)
    with pytest.raises(ValueError):
        units.factor_and_offset("m", "F")


# --- geometry -----------------------------------------------------------------

SURFACE = (
    "model_id string, story_id string, space_id string, surface_id string, surface_type string, boundary string, "
    "gross_area double, vertices array<struct<x:double,y:double,z:double>>"
)


def box(spark, side=10.0, height=3.0, x=0.0, space="s", walls=("Outdoors",) * 4, jitter=0.0, floor="Ground"):
    corners = [(x, 0.0), (x + side, 0.0), (x + side, side), (x, side)]
    rows = [("m", "1", space, space + "-floor", "Floor", floor, side**2, [(a, b, 0.0) for a, b in corners])]
    for k in range(4):
        (px, py), (qx, qy) = corners[k], corners[(k + 1) % 4]
        ring = [(qx + jitter, qy, 0.0), (px + jitter, py, 0.0), (px + jitter, py, height), (qx + jitter, qy, height)]
        rows.append(("m", "1", space, f"{space}-wall{k}", "Wall", walls[k], side * height, ring))
    return spark.createDataFrame(rows, SURFACE)


def test_perimeter_of_a_square(spark):
    assert geometry.perimeter(box(spark)).first().perimeter == pytest.approx(40.0)
    party = box(spark, walls=("Outdoors", "Surface", "Outdoors", "Outdoors"))
    assert geometry.perimeter(party).first().perimeter == pytest.approx(30.0)


@pytest.mark.parametrize("jitter,found", [(0.00009, True), (-0.00009, True), (0.0002, False)])
@pytest.mark.parametrize("x", [0.0, 0.02, 7.77])
def test_edges_match_within_the_tolerance(spark, jitter, found, x):
    assert (geometry.perimeter(box(spark, jitter=jitter, x=x)).count() == 1) is found


def test_edges_of_other_spaces_do_not_match(spark):
    mixed = box(spark).where("surface_type = 'Floor'").unionByName(
        box(spark, space="t").where("surface_type = 'Wall'")
    )
    assert geometry.perimeter(mixed).count() == 0


def story(spark, surfaces, multiplier, with_box=True, **options):
    named = [row.space_id for row in surfaces.select("space_id").distinct().collect()]
    rows = [("m", space, multiplier) for space in options.pop("spaces", named)]
    spaces = spark.createDataFrame(rows, "model_id string, space_id string, multiplier double")
    boxes = geometry.bounding_boxes(surfaces) if with_box else None
    return geometry.story_edges(surfaces, spaces, boxes, ("Outdoors", "Ground", "Adiabatic"), **options)


def test_story_perimeter_and_party_walls(spark):
    adiabatic = box(spark, walls=("Adiabatic", "Outdoors", "Outdoors", "Ground"))
    on_box = story(spark, adiabatic, 2.0)
    row = geometry.story_perimeter(on_box).first()
    assert row.perimeter == pytest.approx(40.0) and row.n_party_edges == 1
    assert [r.surface_id for r in geometry.party_walls(on_box).collect()] == ["s-wall0"]


def test_inner_adiabatic_wall_counts_only_for_a_single_space(spark):
    inner = box(spark, walls=("Outdoors", "Adiabatic", "Outdoors", "Outdoors"))
    larger = inner.unionByName(box(spark, x=10.0, space="t"))
    both = story(spark, larger, 3.0)
    assert geometry.story_perimeter(both.where("space_id = 's'")).first().perimeter == pytest.approx(30.0)
    assert geometry.story_perimeter(both).first().perimeter == pytest.approx(70.0)
    # without a row in ``spaces`` a space counts once
    assert geometry.story_perimeter(story(spark, larger, 3.0, spaces=["s"])).first().perimeter == pytest.approx(70.0)
    assert geometry.story_perimeter(story(spark, larger, 1.0)).first().perimeter == pytest.approx(80.0)
    scaled = story(spark, inner, 3.0, with_box=False, multiplier_adjustment=2.0)
    assert geometry.story_perimeter(scaled).first().perimeter == pytest.approx(60.0)


def test_estimate_and_floor_center(spark):
    assert geometry.estimate_perimeter(box(spark)).first().perimeter == pytest.approx(40.0)
    center = geometry.floor_centers(box(spark), 0.9).first()
    assert (center.x, center.y, center.z) == (5.0, 5.0, 0.9)


def test_lowered_vertices(spark):
    lowered = geometry.lower_vertices(box(spark), 2.0)
    assert lowered.where("lowered").count() == 4
    assert geometry.z_values(lowered).agg(F.max("z")).first()[0] == 2.0


def test_core_and_perimeter_or_one_polygon(spark):
    footprint = spark.createDataFrame(
        [("large", 30.0, 20.0, 0.0, 0.0), ("small", 11.0, 20.0, 0.0, 0.0)],
        "model_id string, length double, width double, x double, y double",
    )
    names = {(r.model_id, r.name) for r in geometry.core_and_perimeter(footprint).collect()}
    assert len([n for m, n in names if m == "large"]) == 5
    assert [n for m, n in names if m == "small"] == ["Whole Story Space"]


def test_window_share_with_multipliers(spark):
    surfaces = box(spark).withColumn("zone_id", F.lit("z"))
    subs = spark.createDataFrame(
        [("m", "s-wall0", 2.0, 3.0)], "model_id string, surface_id string, gross_area double, multiplier double"
    )
    zone = spark.createDataFrame([("m", "z", 2)], "model_id string, zone_id string, multiplier int")
    walls = geometry.exterior_walls(surfaces, subs, zone)
    row = geometry.window_to_wall_ratio(walls).first()
    assert (row.wall_area, row.window_area, row.window_wall_ratio) == (240.0, 12.0, 0.05)
    no_zone = geometry.exterior_walls(surfaces, subs, zone.where("false"))
    assert geometry.window_to_wall_ratio(no_zone).first().wall_area == 120.0
    none = geometry.window_to_wall_ratio(walls.withColumn("wall_area", F.lit(0.0))).first()
    assert none.window_wall_ratio == 0.0


@pytest.mark.parametrize(
    "degrees,side", [(0, "north"), (45, "east"), (124.9, "east"), (125, "south"), (225, "west"), (315, "north")]
)
def test_sides(spark, degrees, side):
    assert spark.range(1).select(geometry.orientation(F.lit(float(degrees)))).first()[0] == side


def test_azimuth_wraps(spark):
    def azimuth(rad, north, **options):
        expr = geometry.absolute_azimuth(F.lit(rad), F.lit(north), F.lit(0.0), **options)
        return spark.range(1).select(expr).first()[0]

    assert azimuth(math.pi, 270.0) == pytest.approx(90.0)
    assert azimuth(0.0, -90.0) == pytest.approx(270.0)
    assert azimuth(0.0, -90.0, compat=True) == pytest.approx(-90.0)


def test_largest_first_then_growing(spark):
    types = spark.createDataFrame(
        [("m", "a", 5.0), ("m", "b", 9.0), ("m", "c", 1.0)], "model_id string, space_type string, floor_area double"
    )
    assert [r.space_type for r in geometry.by_area_largest_first(types).collect()] == ["b", "c", "a"]


# --- zones ------------------------------------------------------------------------


def test_zone_classes_and_plenum(spark, rows):
    zone = spark.createDataFrame(
        [("m", "office", True, 0), ("m", "corridor", False, 2), ("m", "attic", False, 0), ("m", "shed", False, 0)],
        "model_id string, zone_id string, has_thermostat boolean, n_equipment int",
    )
    spaces = spark.createDataFrame(
        [("m", "o1", "office", "Office", "OpenOffice"), ("m", "c1", "corridor", "Hall", "Corridor"),
         ("m", "c2", "corridor", "Office", None), ("m", "a1", "attic", "Plenum", None)],
        "model_id string, space_id string, zone_id string, space_type string, standards_space_type string",
    )
    classes = zones.classify_zones(zone, spaces, ["Corridor"], "Plenum")
    assert rows(classes, "zone_id", "zone_class") == [
        ("attic", "plenum"), ("corridor", "secondary"), ("office", "primary"), ("shed", "unconditioned")
    ]
    unlisted = zones.classify_zones(zone, spaces, [], None)
    assert {r.zone_class for r in unlisted.collect()} == {"primary", "unconditioned"}
    surfaces = spark.createDataFrame(
        [("m", "a1", "pf1", "ceil", "Surface", "Floor", 8.0), ("m", "o1", "ceil", "pf1", "Surface", "RoofCeiling", 8.0),
         ("m", "a1", "pf2", "hall", "Surface", "Floor", 9.0), ("m", "c1", "hall", "pf2", "Surface", "RoofCeiling", 9.0)],
        "model_id string, space_id string, surface_id string, adjacent_surface_id string, boundary string, "
        "surface_type string, gross_area double",
    )
    plenum = zones.plenum_of_zones(surfaces, spaces, classes)
    assert rows(plenum) == [("m", "office", "attic", 8.0)]
    assert rows(zones.untyped_zones(spaces, zone), "zone_id", "problem") == [("shed", "no space")]


def test_counts_of_loops_and_served_zones(spark):
    air = spark.createDataFrame([("m",), ("m",)], "model_id string")
    plant = spark.createDataFrame([("n",)], "model_id string")
    equipment = spark.createDataFrame(
        [("m", "z1", "exhaust_fan"), ("m", "z1", "terminal"), ("m", "z2", "exhaust_fan")],
        "model_id string, zone_id string, equipment_type string",
    )
    got = {r.model_id: tuple(r)[1:] for r in zones.equipment_counts(air, plant, equipment).collect()}
    assert got == {"m": (2, 0, 1), "n": (0, 1, 0)}


def test_tips_and_climate(spark):
    requests = spark.createDataFrame(
        [("c", "K12", "EN02", 0), ("c", "K12", "EN01", 1), ("c", "K12", "EN02", 2), ("c", "K12", "XX", 3)],
        "case_id string, guide string, code string, pos int",
    )
    tips = spark.createDataFrame(
        [("K12", "EN01", "EN1 Cool Roofs"), ("K12", "EN02", "EN2 Roofs")], "guide string, code string, text string"
    )
    row = zones.tip_texts(requests, tips).first()
    assert (row.tips, row.n_unknown) == ("EN2 Roofs, EN1 Cool Roofs", 1)
    got = spark.range(1).select(zones.climate_zone_number(F.lit("3B")), zones.climate_zone_number(F.lit("9"))).first()
    assert tuple(got) == ("3", None)


def test_densities_and_areas(spark):
    spaces = spark.createDataFrame(
        [("m", "a", 10.0, 1.0, 100.0), ("m", "b", 20.0, 2.0, 50.0)],
        "model_id string, space_id string, floor_area double, multiplier double, lighting_power double",
    )
    assert zones.power_density(spaces, "lighting_power").first().density == pytest.approx(4.0)
    assert {r.space_id: (r.area, r.total_area) for r in zones.space_areas(spaces).collect()} == {
        "a": (10.0, 50.0), "b": (40.0, 50.0)
    }
    empty = spaces.withColumn("floor_area", F.lit(0.0))
    assert zones.power_density(empty, "lighting_power").first().density is None


def test_only_wall_edges_at_a_floor_are_matched(spark):
    def ring(*corners):
        return [dict(zip("xyz", map(float, c))) for c in corners]

    data = [
        ("m", "s", "low", ring((4, 0, 0), (0, 0, 0), (0, 0, 3), (4, 0, 3))), ("m", "s", "above", ring((4, 0, 3), (0, 0, 3), (0, 0, 6), (4, 0, 6))),
        ("m", "s", "slope", ring((4, 0, 2), (0, 0, 0), (0, 0, 3), (4, 0, 3))), ("m", "none", "lost", ring((4, 0, 0), (0, 0, 0), (0, 0, 3), (4, 0, 3))),
    ]
    shape = "model_id string, space_id string, surface_id string, vertices array<struct<x:double,y:double,z:double>>"
    walls = spark.createDataFrame(data, shape)
    floors = spark.createDataFrame([("m", "s", "f", ring((0, 0, 0), (4, 0, 0.00005), (4, 4, 0), (0, 4, 0)))], shape)
    used = geometry.edges_at_floors(walls, floors, ["model_id", "space_id"])
    assert [r.surface_id for r in used.collect()] == ["low"]
    assert used.columns == geometry.edges(walls).columns
