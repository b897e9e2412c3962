"""Queries over surfaces, spaces and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions.calendar import minute_stamp
from demandloom.operators import geometry, points, zones
from demandloom.plans import inputs
from demandloom.plans.registry import query

SPACE_SQL = """
sp AS (
  SELECT o_custkey % 10 AS model_id, o_orderpriority AS story_id, o_orderkey AS space_id, o_custkey AS ck,
         CASE WHEN o_orderstatus = 'P' THEN 'Surface' ELSE 'Ground' END AS floor_boundary,
         (o_orderkey % 100) * 50e0 AS x0, (o_orderkey // 100) * 50e0 AS y0,
         3e0 + o_totalprice / 20000 AS L, 5e0 + o_custkey % 20 AS W, (o_orderkey % 4) * 0.00004e0 AS j,
         CAST(1 + o_custkey % 3 AS DOUBLE) AS multiplier FROM orders)"""

EDGE_SQL = SPACE_SQL + """,
side AS (
  SELECT sp.*, k, px, py, qx, qy, CASE k WHEN 0 THEN 'Outdoors' WHEN 1 THEN 'Adiabatic' WHEN 3 THEN 'Ground'
         ELSE CASE WHEN ck % 2 = 0 THEN 'Outdoors' ELSE 'Surface' END END AS wall_boundary
  FROM sp, LATERAL (VALUES (0, x0, y0, x0 + L, y0), (1, x0 + L, y0, x0 + L, y0 + W),
    (2, x0 + L, y0 + W, x0, y0 + W), (3, x0, y0 + W, x0, y0)) v(k, px, py, qx, qy)),
wall_edge AS (
  SELECT model_id, story_id, space_id, multiplier, wall_boundary AS boundary, k, ax, ay, az, bx, b_y, bz
  FROM side, LATERAL (VALUES (qx + j, qy, 0e0, px + j, py, 0e0), (px + j, py, 0e0, px + j, py, 3e0),
    (px + j, py, 3e0, qx + j, qy, 3e0), (qx + j, qy, 3e0, qx + j, qy, 0e0)) v(ax, ay, az, bx, b_y, bz)),
hit AS (
  SELECT w.model_id, w.story_id, w.space_id, w.boundary, w.k, w.multiplier, f.floor_boundary, f.px, f.py, f.qx, f.qy,
         w.ax, w.ay, w.az, w.bx, w.b_y, w.bz
  FROM side f JOIN wall_edge w ON w.space_id = f.space_id
  WHERE abs(f.px - w.bx) <= 1e-4 AND abs(f.py - w.b_y) <= 1e-4 AND abs(0 - w.bz) <= 1e-4
    AND abs(f.qx - w.ax) <= 1e-4 AND abs(f.qy - w.ay) <= 1e-4 AND abs(0 - w.az) <= 1e-4)"""


def rectangles(spark, sf_dir):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    return inputs.table(spark, sf_dir, "orders").select(
        (customer % 10).alias("model_id"), F.col("o_orderpriority").alias("story_id"),
        order.alias("space_id"), customer.alias("ck"),
        F.when(F.col("o_orderstatus") == "P", "Surface").otherwise("Ground").alias("floor_boundary"),
        ((order % 100) * 50.0).alias("x0"), (F.floor(order / 100) * 50.0).alias("y0"),
        (F.col("o_totalprice") / 20000 + 3.0).alias("L"), (customer % 20 + 5.0).alias("W"),
        ((order % 4) * 0.00004).alias("j"), (customer % 3 + 1).cast("double").alias("multiplier"),
    )


def box_surfaces(spark, sf_dir):
    """A floor and four walls per order; some walls are shifted by a tenth of a millimetre."""
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("L"), F.col("y0") + F.col("W")
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    zero, top, j = F.lit(0.0), F.lit(3.0), F.col("j")
    floor = F.array(*(geometry.vertex(x, y, zero) for x, y in corners))
    boundary = [
        F.lit("Outdoors"), F.lit("Adiabatic"),
        F.when(F.col("ck") % 2 == 0, "Outdoors").otherwise("Surface"), F.lit("Ground"),
    ]

    def surface(no, kind, bound, ring):
        return F.struct(
            F.lit(no).alias("surface_no"), F.lit(kind).alias("surface_type"),
            bound.alias("boundary"), ring.alias("vertices"),
        )

    rows = [surface(-1, "Floor", F.col("floor_boundary"), floor)]
    for k in range(4):
        (px, py), (qx, qy) = corners[k], corners[(k + 1) % 4]
        ring = F.array(
            geometry.vertex(qx + j, qy, zero), geometry.vertex(px + j, py, zero),
            geometry.vertex(px + j, py, top), geometry.vertex(qx + j, qy, top),
        )
        rows.append(surface(k, "Wall", boundary[k], ring))
    built = rectangles(spark, sf_dir).select(
        "model_id", "story_id", "space_id", "multiplier", F.inline(F.array(*rows))
    )
    return built.withColumn("surface_id", F.col("space_id") * 10 + F.col("surface_no"))


@query(
    "perimeter",
    f"WITH {EDGE_SQL} SELECT model_id, round(sum(sqrt((px - qx) ** 2 + (py - qy) ** 2)), 4) AS perimeter FROM hit "
    "WHERE floor_boundary = 'Ground' AND boundary = 'Outdoors' GROUP BY 1",
)
def perimeter(spark, sf_dir):
    out = geometry.perimeter(box_surfaces(spark, sf_dir))
    return out.withColumn("perimeter", F.round("perimeter", 4))


STORY_SQL = EDGE_SQL + """,
box AS (SELECT model_id, min(least(x0, x0 + j)) AS x_lo, max(x0 + L + j) AS x_hi, min(y0) AS y_lo, max(y0 + W) AS y_hi FROM sp GROUP BY 1),
st AS (
  SELECT h.*, boundary = 'Adiabatic' AND (multiplier = 1 OR (abs(x_lo - ax) < 1e-4 AND abs(x_lo - bx) < 1e-4)
           OR (abs(x_hi - ax) < 1e-4 AND abs(x_hi - bx) < 1e-4) OR (abs(y_lo - ay) < 1e-4 AND abs(y_lo - b_y) < 1e-4)
           OR (abs(y_hi - ay) < 1e-4 AND abs(y_hi - b_y) < 1e-4)) AS party,
         sqrt((ax - bx) ** 2 + (ay - b_y) ** 2 + (az - bz) ** 2) AS len
  FROM hit h JOIN box USING (model_id) WHERE boundary IN ('Outdoors', 'Ground', 'Adiabatic'))"""


def story(spark, sf_dir):
    surfaces = box_surfaces(spark, sf_dir)
    spaces = rectangles(spark, sf_dir).select("model_id", "space_id", "multiplier")
    return geometry.story_edges(
        surfaces.drop("multiplier"), spaces, geometry.bounding_boxes(surfaces),
        ("Outdoors", "Ground", "Adiabatic"), multiplier_adjustment=2.0,
    )


@query(
    "story_perimeter",
    f"WITH {STORY_SQL} SELECT model_id, story_id, round(sum(CASE WHEN boundary = 'Adiabatic' AND NOT party THEN 0 "
    "ELSE len END * multiplier / 2), 4) AS perimeter, count(*) FILTER (party) AS n_party_edges FROM st GROUP BY 1, 2",
)
def story_perimeter(spark, sf_dir):
    out = geometry.story_perimeter(story(spark, sf_dir))
    return out.withColumn("perimeter", F.round("perimeter", 4))


@query(
    "party_walls",
    f"WITH {STORY_SQL} SELECT DISTINCT model_id, story_id, space_id * 10 + k AS surface_id FROM st WHERE party",
)
def party_walls(spark, sf_dir):
    return geometry.party_walls(story(spark, sf_dir))


@query(
    "perimeter_estimate",
    f"WITH {EDGE_SQL} SELECT model_id, story_id, round(sum(sqrt((px - qx) ** 2 + (py - qy) ** 2)), 4) AS perimeter "
    "FROM side WHERE wall_boundary = 'Outdoors' GROUP BY 1, 2",
)
def perimeter_estimate(spark, sf_dir):
    low, high = geometry.extent("z")
    v = F.col("vertices")
    base = F.sqrt(F.pow(v[0]["x"] - v[1]["x"], F.lit(2)) + F.pow(v[0]["y"] - v[1]["y"], F.lit(2)))
    sized = box_surfaces(spark, sf_dir).withColumn("gross_area", base * (high - low))
    out = geometry.estimate_perimeter(sized)
    return out.withColumn("perimeter", F.round("perimeter", 4))


@query(
    "lowered_surfaces",
    f"WITH {SPACE_SQL} SELECT model_id, count(*) * 5 AS n_surfaces, count(*) * 4 AS n_lowered, "
    "round(count(*) * 20e0, 3) AS sum_z FROM sp GROUP BY 1",
)
def lowered_surfaces(spark, sf_dir):
    lowered = geometry.lower_vertices(box_surfaces(spark, sf_dir), 2.5)
    total = F.aggregate("vertices", F.lit(0.0), lambda acc, v: acc + v["z"])
    return lowered.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_surfaces"), F.count_if("lowered").alias("n_lowered"),
        F.round(F.sum(total), 3).alias("sum_z"),
    )


@query(
    "surface_z_values",
    f"WITH {SPACE_SQL} SELECT space_id * 10 + k AS surface_id, CAST(n AS INTEGER) AS vertex_no, "
    "CASE WHEN k >= 0 AND n >= 2 THEN 3e0 ELSE 0e0 END AS z FROM sp, range(-1, 4) a(k), range(4) b(n)",
)
def surface_z_values(spark, sf_dir):
    return geometry.z_values(box_surfaces(spark, sf_dir), ["surface_id"])


@query(
    "floor_centers",
    f"WITH {SPACE_SQL} SELECT space_id, round(x0 + L / 2, 9) AS x, round(y0 + W / 2, 9) AS y, 0.9e0 AS z FROM sp",
)
def floor_centers(spark, sf_dir):
    out = geometry.floor_centers(box_surfaces(spark, sf_dir), 0.9, ["space_id"])
    return out.select("space_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "z")


@query(
    "core_and_perimeter",
    """WITH r AS (SELECT o_orderkey, 5e0 + o_totalprice / 10000 AS L, 8e0 + o_custkey % 20 AS W, 15 * 0.3048e0 AS d FROM orders),
p AS (SELECT o_orderkey, name, CASE name WHEN 'Core Space' THEN (L - 2 * d) * (W - 2 * d)
  WHEN 'West Perimeter Space' THEN d * (W - d) WHEN 'East Perimeter Space' THEN d * (W - d) ELSE d * (L - d) END AS area
  FROM r, (SELECT unnest(['West Perimeter Space', 'North Perimeter Space', 'East Perimeter Space', 'South Perimeter Space', 'Core Space']) AS name)
  WHERE L > 2.5e0 * d AND W > 2.5e0 * d
  UNION ALL SELECT o_orderkey, 'Whole Story Space', L * W FROM r WHERE NOT (L > 2.5e0 * d AND W > 2.5e0 * d))
SELECT o_orderkey, name, round(area, 9) AS area FROM p""",
)
def core_and_perimeter(spark, sf_dir):
    footprints = inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 10000 + 5.0).alias("length"),
        (F.col("o_custkey") % 20 + 8.0).alias("width"), F.lit(10.0).alias("x"), F.lit(20.0).alias("y"),
    )
    polygons = geometry.core_and_perimeter(footprints, keys=["o_orderkey"])
    ring = F.col("vertices")
    # Shoelace area of the ring.
    cross = F.transform(
        ring,
        lambda v, i: v["x"] * F.get(ring, (i + 1) % F.size(ring))["y"]
        - F.get(ring, (i + 1) % F.size(ring))["x"] * v["y"],
    )
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, c: acc + c)) / 2
    return polygons.select("o_orderkey", "name", F.round(area, 9).alias("area"))


WALL_SQL = """
opening AS (SELECT l_orderkey AS surface_id, sum(l_extendedprice / 100 * l_linenumber) AS open FROM lineitem GROUP BY 1),
wall AS (
  SELECT o_orderkey AS surface_id, o_orderpriority AS story_id,
         o_totalprice * coalesce(c_nationkey % 3 + 1, 1) AS wall_area,
         coalesce(open, 0) * coalesce(c_nationkey % 3 + 1, 1) AS window_area,
         (o_orderkey % 360 + 0.5e0) + o_custkey % 40 - 60 AS raw_azimuth
  FROM orders LEFT JOIN opening ON surface_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
  WHERE o_orderstatus <> 'P')"""


def walls(spark, sf_dir):
    one = F.lit(1)
    order = F.col("o_orderkey")
    surfaces = inputs.table(spark, sf_dir, "orders").select(
        one.alias("model_id"), order.alias("surface_id"), F.col("o_custkey").alias("zone_id"),
        F.col("o_orderpriority").alias("story_id"),
        F.when(F.col("o_orderstatus") == "P", "Floor").otherwise("Wall").alias("surface_type"),
        F.lit("Outdoors").alias("boundary"), F.col("o_totalprice").alias("gross_area"),
        F.radians(order % 360 + 0.5).alias("azimuth_rad"), (F.col("o_custkey") % 40).alias("space_north"),
    )
    subs = inputs.table(spark, sf_dir, "lineitem").select(
        one.alias("model_id"), F.col("l_orderkey").alias("surface_id"),
        (F.col("l_extendedprice") / 100).alias("gross_area"), F.col("l_linenumber").alias("multiplier"),
    )
    zone = inputs.table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(
        one.alias("model_id"), F.col("c_custkey").alias("zone_id"), (F.col("c_nationkey") % 3 + 1).alias("multiplier")
    )
    return geometry.exterior_walls(surfaces, subs, zone)


@query(
    "window_wall_ratio",
    f"WITH {WALL_SQL} SELECT story_id, round(sum(wall_area), 2) AS wall_area, round(sum(window_area), 2) AS window_area, "
    "round(sum(window_area) / sum(wall_area), 6) AS window_wall_ratio FROM wall GROUP BY 1",
)
def window_wall_ratio(spark, sf_dir):
    out = geometry.window_to_wall_ratio(walls(spark, sf_dir), ["story_id"])
    return out.select(
        "story_id", F.round("wall_area", 2).alias("wall_area"), F.round("window_area", 2).alias("window_area"),
        F.round("window_wall_ratio", 6).alias("window_wall_ratio"),
    )


SIDES = ["north", "east", "south", "west"]
SIDE_SQL = (
    "CASE WHEN az >= 45 AND az < 125 THEN 'east' WHEN az >= 125 AND az < 225 THEN 'south' "
    "WHEN az >= 225 AND az < 315 THEN 'west' ELSE 'north' END"
)


def azimuth():
    return geometry.absolute_azimuth(F.col("azimuth_rad"), F.col("space_north"), F.lit(-60.0))


@query(
    "wall_area_by_orientation",
    f"WITH {WALL_SQL}, a AS (SELECT *, CASE WHEN raw_azimuth < 0 THEN raw_azimuth + 360 WHEN raw_azimuth >= 360 "
    f"THEN raw_azimuth - 360 ELSE raw_azimuth END AS az FROM wall), s AS (SELECT *, {SIDE_SQL} AS side FROM a) "
    "SELECT story_id, "
    + ", ".join(
        f"round(sum({kind}_area) FILTER (side = '{s}'), 2) AS {s}_{kind}" for s in SIDES for kind in ("wall", "window")
    )
    + " FROM s GROUP BY 1",
)
def wall_area_by_orientation(spark, sf_dir):
    out = geometry.area_by_orientation(walls(spark, sf_dir), azimuth(), ["story_id"])
    return out.withColumns({c: F.round(c, 2) for c in out.columns if c != "story_id"})


@query(
    "absolute_azimuth",
    f"WITH {WALL_SQL} SELECT surface_id, round(CASE WHEN raw_azimuth < 0 THEN raw_azimuth + 360 "
    "WHEN raw_azimuth >= 360 THEN raw_azimuth - 360 ELSE raw_azimuth END, 4) AS azimuth FROM wall",
)
def absolute_azimuth(spark, sf_dir):
    return walls(spark, sf_dir).select("surface_id", F.round(azimuth(), 4).alias("azimuth"))


@query(
    "absolute_azimuth_unwrapped",
    f"WITH {WALL_SQL} SELECT surface_id, round(CASE WHEN raw_azimuth >= 360 THEN raw_azimuth - 360 "
    "ELSE raw_azimuth END, 4) AS azimuth FROM wall",
)
def absolute_azimuth_unwrapped(spark, sf_dir):
    angle = geometry.absolute_azimuth(F.col("azimuth_rad"), F.col("space_north"), F.lit(-60.0), compat=True)
    return walls(spark, sf_dir).select("surface_id", F.round(angle, 4).alias("azimuth"))


def spaces_of_parts(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model_id"), F.col("p_partkey").alias("space_id"),
        F.col("p_type").alias("space_type"), F.col("p_size").cast("double").alias("floor_area"),
        (F.col("p_partkey") % 3 + 1).alias("multiplier"), F.col("p_retailprice").alias("lighting_power"),
    )


@query(
    "power_density",
    "SELECT p_brand AS model_id, round(sum(p_retailprice * (p_partkey % 3 + 1)) / sum(p_size * (p_partkey % 3 + 1)), 6) "
    "AS density FROM part GROUP BY 1",
)
def power_density(spark, sf_dir):
    out = zones.power_density(spaces_of_parts(spark, sf_dir), "lighting_power")
    return out.withColumn("density", F.round("density", 6))


@query(
    "space_areas",
    "SELECT p_brand AS model_id, p_partkey AS space_id, p_size * (p_partkey % 3 + 1) * 1e0 AS area, "
    "sum(p_size * (p_partkey % 3 + 1) * 1e0) OVER (PARTITION BY p_brand) AS total_area FROM part",
)
def space_areas(spark, sf_dir):
    return zones.space_areas(spaces_of_parts(spark, sf_dir))


@query(
    "largest_space_type_first",
    """WITH t AS (SELECT p_brand AS model_id, p_type AS space_type, CAST(sum(p_size) AS BIGINT) AS floor_area FROM part GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY floor_area DESC, space_type DESC) = 1 AS is_largest FROM t""",
)
def largest_space_type_first(spark, sf_dir):
    types = spaces_of_parts(spark, sf_dir).groupBy("model_id", "space_type").agg(
        F.sum(F.col("floor_area").cast("long")).alias("floor_area")
    )
    return geometry.by_area_largest_first(types)


@query(
    "used_space_types",
    "SELECT DISTINCT p_brand AS model_id, p_type AS space_type, 'std ' || p_type AS standards_space_type FROM part "
    "WHERE (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM part WHERE p_size > 45)",
)
def used_space_types(spark, sf_dir):
    parts = spaces_of_parts(spark, sf_dir)
    types = parts.select("model_id", "space_type").distinct().withColumn(
        "standards_space_type", F.concat(F.lit("std "), F.col("space_type"))
    )
    return zones.used_space_types(types, parts.where(F.col("floor_area") > 45))


@query(
    "space_type_standards",
    """SELECT p_partkey AS space_id, coalesce(b, 'none') AS standards_building, coalesce(s, 'none') AS standards_space_type
FROM part LEFT JOIN (SELECT p_brand AS m, p_type AS t, 'b' || max(p_size) AS b, CASE WHEN min(p_size) < 5 THEN 's' || min(p_size) END AS s
  FROM part WHERE p_size < 40 GROUP BY 1, 2) x ON m = p_brand AND t = p_type""",
)
def space_type_standards(spark, sf_dir):
    parts = spaces_of_parts(spark, sf_dir)
    low, high = F.min("floor_area").cast("int"), F.max("floor_area").cast("int")
    types = parts.where(F.col("floor_area") < 40).groupBy("model_id", "space_type").agg(
        F.concat(F.lit("b"), high.cast("string")).alias("standards_building"),
        F.when(low < 5, F.concat(F.lit("s"), low.cast("string"))).alias("standards_space_type"),
    )
    out = zones.space_type_standards(parts, types)
    return out.select(
        "space_id", F.coalesce("standards_building", F.lit("none")).alias("standards_building"),
        F.coalesce("standards_space_type", F.lit("none")).alias("standards_space_type"),
    )


def zone_tables(spark, sf_dir, model=None):
    def model_of(key):
        return F.lit(model).alias("model_id") if model else (F.col(key) % 10).alias("model_id")

    zone = inputs.table(spark, sf_dir, "customer").select(
        model_of("c_custkey"), F.col("c_custkey").alias("zone_id"),
        (F.col("c_acctbal") > 7000).alias("has_thermostat"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("n_equipment"),
    )
    spaces = inputs.table(spark, sf_dir, "orders").select(
        model_of("o_custkey"), F.col("o_orderkey").alias("space_id"), F.col("o_custkey").alias("zone_id"),
        F.col("o_orderpriority").alias("space_type"), F.col("o_orderstatus").alias("standards_space_type"),
    )
    return zone, spaces


CLASS_SQL = """
fact AS (SELECT o_custkey AS zone_id, bool_or(o_orderstatus = 'P') AS sec, bool_or(o_orderpriority = '5-LOW') AS ple
  FROM orders GROUP BY 1),
cls AS (SELECT c_custkey AS zone_id, CASE WHEN c_acctbal > 7000 OR c_mktsegment = 'BUILDING'
  THEN CASE WHEN coalesce(sec, false) THEN 'secondary' ELSE 'primary' END
  ELSE CASE WHEN coalesce(ple, false) THEN 'plenum' ELSE 'unconditioned' END END AS zone_class
  FROM customer LEFT JOIN fact ON zone_id = c_custkey)"""


@query("zone_classes", f"WITH {CLASS_SQL} SELECT zone_id % 10 AS model_id, zone_id, zone_class FROM cls")
def zone_classes(spark, sf_dir):
    return zones.classify_zones(*zone_tables(spark, sf_dir), ["P"], "5-LOW")


@query(
    "zone_plenums",
    f"""WITH {CLASS_SQL},
fl AS (SELECT o_orderkey + 1 AS below, o_custkey AS plenum_zone_id, o_totalprice AS a FROM orders JOIN cls ON zone_id = o_custkey
       WHERE zone_class = 'plenum'),
hit AS (SELECT o_custkey AS zone_id, plenum_zone_id, a FROM fl JOIN orders ON o_orderkey = below JOIN cls ON cls.zone_id = o_custkey
        WHERE zone_class = 'primary')
SELECT zone_id, plenum_zone_id, a AS shared_area FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY a DESC, plenum_zone_id) AS rn FROM hit)
WHERE rn = 1""",
)
def zone_plenums(spark, sf_dir):
    zone, spaces = zone_tables(spark, sf_dir, model=1)
    # Any zone may hold a primary space here: secondary types are not used.
    classes = zones.classify_zones(zone, spaces, ["P"], "5-LOW")
    surfaces = inputs.table(spark, sf_dir, "orders").select(
        F.lit(1).alias("model_id"), F.col("o_orderkey").alias("space_id"), F.col("o_orderkey").alias("surface_id"),
        (F.col("o_orderkey") + 1).alias("adjacent_surface_id"), F.lit("Surface").alias("boundary"),
        F.lit("Floor").alias("surface_type"), F.col("o_totalprice").alias("gross_area"),
    )
    return zones.plenum_of_zones(surfaces, spaces, classes).drop("model_id")


@query(
    "untyped_zones",
    """SELECT c_custkey AS zone_id, CASE WHEN n IS NULL THEN 'no space' ELSE 'space without type' END AS problem
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, bool_or(o_totalprice > 400000) AS bad FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE n IS NULL OR bad""",
)
def untyped_zones(spark, sf_dir):
    zone, _ = zone_tables(spark, sf_dir)
    spaces = inputs.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).alias("model_id"), F.col("o_custkey").alias("zone_id"),
        F.when(F.col("o_totalprice") <= 400000, F.col("o_orderpriority")).alias("space_type"),
    )
    return zones.untyped_zones(spaces, zone).drop("model_id")


@query(
    "equipment_counts",
    """WITH a AS (SELECT s_nationkey AS model_id, count(*) AS n FROM supplier GROUP BY 1),
p AS (SELECT c_nationkey AS model_id, count(*) AS n FROM customer GROUP BY 1),
z AS (SELECT p_size % 25 AS model_id, p_name, bool_or(p_type <> 'PROMO') AS served FROM part GROUP BY 1, 2),
q AS (SELECT model_id, count(*) FILTER (served) AS n FROM z GROUP BY 1)
SELECT model_id, coalesce(a.n, 0) AS n_air_loops, coalesce(p.n, 0) AS n_plant_loops, coalesce(q.n, 0) AS n_zones
FROM a FULL JOIN p USING (model_id) FULL JOIN q USING (model_id)""",
)
def equipment_counts(spark, sf_dir):
    air = inputs.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("model_id"))
    plant = inputs.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("model_id"))
    equipment = inputs.table(spark, sf_dir, "part").select(
        (F.col("p_size") % 25).alias("model_id"), F.col("p_name").alias("zone_id"),
        F.when(F.col("p_type") == "PROMO", "exhaust_fan").otherwise("terminal").alias("equipment_type"),
    )
    return zones.equipment_counts(air, plant, equipment)


@query(
    "representative_loops",
    """WITH n AS (SELECT c_nationkey AS model_id, c_mktsegment AS air_loop, count(*) AS n_spaces FROM customer JOIN orders ON o_custkey = c_custkey
  WHERE o_orderpriority LIKE '%HIGH%' GROUP BY 1, 2)
SELECT model_id, air_loop, n_spaces FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY n_spaces DESC, air_loop) AS rn FROM n) WHERE rn = 1""",
)
def representative_loops(spark, sf_dir):
    customer = inputs.table(spark, sf_dir, "customer")
    loops = customer.select(
        F.col("c_nationkey").alias("model_id"), F.col("c_custkey").alias("zone_id"), F.col("c_mktsegment").alias("air_loop")
    )
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("zone_id"), F.col("o_orderkey").alias("space_id"), F.col("o_orderpriority").alias("space_type")
    )
    spaces = orders.join(loops.drop("air_loop"), "zone_id")
    return zones.representative_loop(loops, spaces, "HIGH")


@query(
    "exterior_lighting",
    "SELECT l_suppkey AS model_id, round(sum(l_extendedprice * l_linenumber), 2) AS exterior_lighting_power, "
    "count(*) AS n_lights FROM lineitem GROUP BY 1",
)
def exterior_lighting(spark, sf_dir):
    lights = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model_id"), F.col("l_extendedprice").alias("design_level"),
        F.col("l_linenumber").alias("multiplier"),
    )
    out = zones.exterior_lighting(lights)
    return out.withColumn("exterior_lighting_power", F.round("exterior_lighting_power", 2))


def light_loads(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model_id"), F.col("l_orderkey").alias("light_id"),
        F.when(F.col("l_quantity") > 5, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("schedule_id"),
        (F.col("l_linestatus") == "O").alias("defaulted"),
    )


@query(
    "hard_assigned_schedules",
    "SELECT l_suppkey AS model_id, l_returnflag || l_linenumber AS schedule_id, count(*) AS n_uses FROM lineitem "
    "WHERE l_quantity > 5 AND l_linestatus <> 'O' GROUP BY 1, 2",
)
def hard_assigned_schedules(spark, sf_dir):
    return zones.hard_assigned_schedules(light_loads(spark, sf_dir))


@query(
    "lights_with_schedule",
    """WITH known AS (SELECT DISTINCT l_suppkey AS m, l_returnflag || l_linenumber AS s FROM lineitem WHERE l_discount > 0.07)
SELECT l_suppkey AS model_id, CASE WHEN s IS NULL THEN 'no schedule' ELSE 'ok' END AS status, count(*) AS n
FROM lineitem LEFT JOIN known ON m = l_suppkey AND s = l_returnflag || l_linenumber AND l_quantity > 5 GROUP BY 1, 2""",
)
def lights_with_schedule(spark, sf_dir):
    known = inputs.table(spark, sf_dir, "lineitem").where(F.col("l_discount") > 0.07).select(
        F.col("l_suppkey").alias("model_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("schedule_id")
    ).distinct()
    marked = zones.lights_with_schedule(light_loads(spark, sf_dir), known)
    return marked.groupBy("model_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "climate_zone_numbers",
    "SELECT c_custkey, CASE WHEN c_nationkey // 10 BETWEEN 1 AND 8 THEN CAST(c_nationkey // 10 AS VARCHAR) "
    "WHEN c_nationkey < 10 AND c_nationkey BETWEEN 1 AND 8 THEN CAST(c_nationkey AS VARCHAR) ELSE 'none' END AS zone_number FROM customer",
)
def climate_zone_numbers(spark, sf_dir):
    zone = F.concat(F.col("c_nationkey").cast("string"), F.lit("A"))
    return inputs.table(spark, sf_dir, "customer").select(
        "c_custkey", F.coalesce(zones.climate_zone_number(zone), F.lit("none")).alias("zone_number")
    )


@query(
    "tip_texts",
    """WITH req AS (SELECT l_orderkey AS case_id, l_partkey % 40 AS code, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2),
tip AS (SELECT n_nationkey AS code, 'Tip ' || n_name AS text FROM nation)
SELECT case_id, coalesce(string_agg(text, ', ' ORDER BY pos, text) FILTER (text IS NOT NULL), '') AS tips,
count(*) FILTER (text IS NULL) AS n_unknown FROM req LEFT JOIN tip USING (code) GROUP BY 1""",
)
def tip_texts(spark, sf_dir):
    requests = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.lit("guide").alias("guide"),
        (F.col("l_partkey") % 40).alias("code"), F.col("l_linenumber").alias("pos"),
    )
    tips = inputs.table(spark, sf_dir, "nation").select(
        F.lit("guide").alias("guide"), F.col("n_nationkey").cast("long").alias("code"),
        F.concat(F.lit("Tip "), F.col("n_name")).alias("text"),
    )
    return zones.tip_texts(requests, tips).drop("guide")


@query("choice_list", "SELECT DISTINCT p_name AS name, p_type AS handle FROM part")
def choice_list(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("handle"))
    return zones.choices(parts, "name", "handle")


@query(
    "preview_meter",
    f"WITH {inputs.RAW_METER_SQL} SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(bldg_kw, 6) AS bldg_kw "
    "FROM meter ORDER BY meter.run_id, meter.ts LIMIT 5",
)
def preview_meter(spark, sf_dir):
    head = zones.preview(inputs.meter(spark, sf_dir), ["run_id", "ts"])
    return head.select(
        "run_id", minute_stamp(F.col("ts")).alias("ts"), F.round("bldg_kw", 6).alias("bldg_kw")
    )


# Two floors per space, side by side; the second one rises by half a metre per metre in every third space. Windows are the walls.
FLOOR_POINT_SQL = f"""WITH {SPACE_SQL},
wall AS (SELECT sp.*, k, L / 2 AS half, CASE WHEN space_id % 3 = 0 THEN 0.5e0 ELSE 0e0 END AS slope, (space_id % 7) * 2e0 AS d
  FROM sp, (SELECT unnest([0, 1, 2, 3]) AS k)),
pt AS (SELECT *, CASE k WHEN 1 THEN x0 + L + j - d WHEN 3 THEN x0 + j + d ELSE x0 + j + L / 2 END - x0 AS a,
         CASE k WHEN 0 THEN y0 + d WHEN 2 THEN y0 + W - d ELSE y0 + W / 2 END - y0 AS b, 0.75e0 AS z FROM wall),
off AS (SELECT *, greatest(0, -a, a - half) AS a1, greatest(0, -b, b - W) AS b1,
         half + ((a - half) + slope * z) / (1 + slope * slope) AS t FROM pt),
hit AS (SELECT *, a1 * a1 + b1 * b1 <= 0.0001e0 AS first,
         greatest(0, half - t, t - L) ** 2 * (1 + slope * slope) + b1 * b1 <= 0.0001e0 AS second FROM off)
SELECT model_id, space_id, space_id * 10 + k AS point_id, CAST(first AS BIGINT) + CAST(second AS BIGINT) AS n_floors,
       CASE WHEN first THEN space_id * 10 + 5 WHEN second THEN space_id * 10 + 6 END AS floor_id, first OR second AS on_floor FROM hit"""


@query("window_points_on_floors", FLOOR_POINT_SQL)
def window_points_on_floors(spark, sf_dir):
    space, x0, y0 = F.col("space_id"), F.col("x0"), F.col("y0")
    half, y1, zero = F.col("L") / 2, F.col("y0") + F.col("W"), F.lit(0.0)
    rise = F.when(space % 3 == 0, half * 0.5).otherwise(0.0)

    def floor(no, left, right, top):
        corners = [(left, y0, zero), (left, y1, zero), (right, y1, top), (right, y0, top)]
        return F.struct((space * 10 + no).alias("surface_id"), F.array(*(geometry.vertex(*c) for c in corners)).alias("vertices"))

    floors = rectangles(spark, sf_dir).select(
        "model_id", "space_id", F.inline(F.array(floor(5, x0, x0 + half, zero), floor(6, x0 + half, x0 + 2 * half, rise)))
    )
    walls = box_surfaces(spark, sf_dir).where(F.col("surface_type") == "Wall").withColumn("vertices", F.reverse("vertices"))
    reference = floors.where(F.col("surface_id") % 10 == 5)
    placed = points.window_points(walls.drop("story_id"), reference, space % 7 * 2.0, 0.75)
    return points.points_on_floors(placed.withColumnRenamed("surface_id", "point_id"), floors)
