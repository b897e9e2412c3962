"""Surfaces, spaces and stories of many models at once.

Vertices are arrays of ``(x, y, z)`` in building coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.units import convert

TOLERANCE = 1e-4
CELL = 0.02
# Uneven weights keep points of a regular grid apart.
AXIS_WEIGHTS = {"x": 1.0, "y": 2.7, "z": 7.3}


# --- vertices --------------------------------------------------------------


def vertex(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def lower_vertices(surfaces: DataFrame, height: float) -> DataFrame:
    """Bring vertices above ``height`` down to it; ``lowered`` tells which surfaces changed."""
    return surfaces.withColumns(
        {
            "lowered": F.exists("vertices", lambda v: v["z"] > height),
            "vertices": F.transform(
                "vertices", lambda v: vertex(v["x"], v["y"], F.least(v["z"], F.lit(float(height))))
            ),
        }
    )


def z_values(surfaces: DataFrame, keys: Sequence[str] = ("model_id", "surface_id")) -> DataFrame:
    return surfaces.select(*keys, F.posexplode("vertices").alias("vertex_no", "v")).select(
        *keys, "vertex_no", F.col("v.z").alias("z")
    )


def extent(axis: str) -> tuple[Column, Column]:
    values = F.transform("vertices", lambda v: v[axis])
    return F.array_min(values), F.array_max(values)


def floor_centers(
    surfaces: DataFrame, z_offset: float, keys: Sequence[str] = ("model_id", "space_id")
) -> DataFrame:
    """Middle of the bounding box of each space's floors, ``z_offset`` above the lowest."""
    (x0, x1), (y0, y1), (z0, _) = extent("x"), extent("y"), extent("z")
    return (
        surfaces.where(F.col("surface_type") == "Floor")
        .groupBy(*keys)
        .agg(
            ((F.min(x0) + F.max(x1)) / 2).alias("x"),
            ((F.min(y0) + F.max(y1)) / 2).alias("y"),
            (F.min(z0) + F.lit(float(z_offset))).alias("z"),
        )
    )


def core_and_perimeter(
    footprints: DataFrame, depth: float = 15 * 0.3048, keys: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Core and four perimeter polygons of a rectangle, or the whole rectangle when it is small.

    ``footprints``: ``length, width`` and the center ``x, y``.
    """
    length, width = F.col("length"), F.col("width")
    west, south = F.col("x") - length / 2.0, F.col("y") - width / 2.0
    east, north = west + length, south + width
    d = F.lit(float(depth))
    corner = {
        "nw": (west, north), "ne": (east, north), "se": (east, south), "sw": (west, south),
        "inw": (west + d, north - d), "ine": (east - d, north - d),
        "ise": (east - d, south + d), "isw": (west + d, south + d),
    }

    def polygon(name: str, *corners: str) -> Column:
        ring = F.array(*(vertex(corner[c][0], corner[c][1], F.lit(0.0)) for c in corners))
        return F.struct(F.lit(name).alias("name"), ring.alias("vertices"))

    zoned = F.array(
        polygon("West Perimeter Space", "sw", "nw", "inw", "isw"),
        polygon("North Perimeter Space", "nw", "ne", "ine", "inw"),
        polygon("East Perimeter Space", "ne", "se", "ise", "ine"),
        polygon("South Perimeter Space", "se", "sw", "isw", "ise"),
        polygon("Core Space", "isw", "inw", "ine", "ise"),
    )
    whole = F.array(polygon("Whole Story Space", "sw", "nw", "ne", "se"))
    large = (length > 2.5 * depth) & (width > 2.5 * depth)
    return footprints.select(*keys, F.inline(F.when(large, zoned).otherwise(whole)))


# --- orientation and window share --------------------------------------------


def absolute_azimuth(
    azimuth_rad: Column, space_north: Column, building_north: Column, compat: bool = False
) -> Column:
    """Degrees from north in [0, 360); ``compat`` lets negative angles stand."""
    degrees = convert(azimuth_rad, "rad", "deg") + space_north + building_north
    if compat:
        return F.when(degrees < 360, degrees).otherwise(F.pmod(degrees, F.lit(360.0)))
    return F.pmod(degrees, F.lit(360.0))


def orientation(
    azimuth: Column, north_east=45.0, south_east=125.0, south_west=225.0, north_west=315.0
) -> Column:
    return (
        F.when((azimuth >= north_east) & (azimuth < south_east), "east")
        .when((azimuth >= south_east) & (azimuth < south_west), "south")
        .when((azimuth >= south_west) & (azimuth < north_west), "west")
        .otherwise("north")
    )


def exterior_walls(surfaces: DataFrame, sub_surfaces: DataFrame, zones: DataFrame) -> DataFrame:
    """Exterior walls with wall and window area, both times the zone multiplier.

    Openings are summed per wall first, so a wall meets one row.
    """
    openings = sub_surfaces.groupBy("model_id", "surface_id").agg(
        F.sum(F.col("gross_area") * F.col("multiplier")).alias("_open")
    )
    factor = F.coalesce(F.col("zone_multiplier"), F.lit(1.0))
    walls = surfaces.where((F.col("surface_type") == "Wall") & (F.col("boundary") == "Outdoors"))
    return (
        walls.join(openings, ["model_id", "surface_id"], "left")
        .join(zones.select("model_id", "zone_id", F.col("multiplier").cast("double").alias("zone_multiplier")),
              ["model_id", "zone_id"], "left")
        .withColumns(
            {
                "wall_area": F.col("gross_area") * factor,
                "window_area": F.coalesce("_open", F.lit(0.0)) * factor,
            }
        )
        .drop("_open")
    )


def window_to_wall_ratio(walls: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Window share of the exterior walls, 0 without any wall area."""
    wall, window = F.sum("wall_area"), F.sum("window_area")
    return walls.groupBy(*keys).agg(
        wall.alias("wall_area"), window.alias("window_area"),
        F.when(wall > 0, window / wall).otherwise(F.lit(0.0)).alias("window_wall_ratio"),
    )


def area_by_orientation(
    walls: DataFrame, azimuth: Column, keys: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Wall and window area to each of the four sides, one row per model."""
    side = orientation(azimuth)
    sums = []
    for name in ("north", "east", "south", "west"):
        for kind in ("wall", "window"):
            area = F.when(side == name, F.col(kind + "_area")).otherwise(F.lit(0.0))
            sums.append(F.sum(area).alias(f"{name}_{kind}"))
    return walls.groupBy(*keys).agg(*sums)


# --- perimeter -----------------------------------------------------------------


def edges(surfaces: DataFrame) -> DataFrame:
    """Directed edges of each surface, the last one back to the first vertex."""
    ring = F.col("vertices")
    rotated = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    pairs = F.arrays_zip(ring.alias("p"), rotated.alias("q"))
    return surfaces.withColumn("_edge", F.explode(pairs)).select(
        *(c for c in surfaces.columns if c != "vertices"), "_edge.p", "_edge.q"
    )


def edge_length(p: str = "p", q: str = "q") -> Column:
    squares = [F.pow(F.col(f"{p}.{a}") - F.col(f"{q}.{a}"), F.lit(2)) for a in ("x", "y", "z")]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def _position(point: str) -> Column:
    """A point as one number, on which points within the tolerance differ little."""
    return sum((F.col(f"{point}.{axis}") * w for axis, w in AXIS_WEIGHTS.items()), F.lit(0.0))


def _cell(position: Column) -> Column:
    return F.floor(position / CELL)


def match_edges(floor_edges: DataFrame, wall_edges: DataFrame, space: Sequence[str]) -> DataFrame:
    """Floor edges that some wall has in the opposite direction, within the tolerance.

    The start of a floor edge gives one number and the line of such numbers is
    cut into cells. A floor edge lies in one cell; a wall edge is entered in the
    one or two cells its end may match into. So only edges that nearly coincide
    meet, however many a space has, and each pair meets once. Edges are unfolded
    rows of unknown number, so neither side is offered for broadcast.
    """
    floors = floor_edges.select(
        *space, F.col("p").alias("fp"), F.col("q").alias("fq"), _cell(_position("p")).alias("_cell")
    )
    reach = TOLERANCE * sum(AXIS_WEIGHTS.values())
    near = F.array_distinct(F.array(_cell(_position("q") - reach), _cell(_position("q") + reach)))
    met = floors.join(wall_edges.withColumn("_cell", F.explode(near)).hint("merge"), [*space, "_cell"])
    close = F.lit(True)
    for axis in AXIS_WEIGHTS:
        close = close & (F.abs(F.col(f"fp.{axis}") - F.col(f"q.{axis}")) <= TOLERANCE)
        close = close & (F.abs(F.col(f"fq.{axis}") - F.col(f"p.{axis}")) <= TOLERANCE)
    return met.where(close).drop("_cell")


def edges_at_floors(walls: DataFrame, floors: DataFrame, space: Sequence[str]) -> DataFrame:
    """Edges of the walls that lie at the height of the space's floors; no other can match a floor's edge.

    Heights meet the walls while these are one row each. A wall has three or more edges and mostly one at
    a floor, so the match shuffles few of them.
    """
    low, high = extent("z")
    heights = floors.groupBy(*space).agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
    used = edges(walls.join(heights.hint("merge"), list(space)))
    at_floor = F.lit(True)
    for end in ("p", "q"):
        z = F.col(f"{end}.z")
        # Twice the tolerance, as rounding here must not decide; the match does.
        at_floor = at_floor & (z >= F.col("_low") - 2 * TOLERANCE) & (z <= F.col("_high") + 2 * TOLERANCE)
    return used.where(at_floor).drop("_low", "_high")


def perimeter(surfaces: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Length of the edges shared by a ground floor and an exterior wall of the same space."""
    space = [*keys, "space_id"]
    ground = surfaces.where((F.col("surface_type") == "Floor") & (F.col("boundary") == "Ground"))
    outdoor = surfaces.where((F.col("surface_type") == "Wall") & (F.col("boundary") == "Outdoors"))
    matched = match_edges(edges(ground), edges_at_floors(outdoor, ground, space), space)
    return matched.groupBy(*keys).agg(F.sum(edge_length("fp", "fq")).alias("perimeter"))


def story_edges(
    surfaces: DataFrame,
    spaces: DataFrame,
    boxes: DataFrame | None = None,
    boundaries: Sequence[str] = ("Outdoors", "Ground"),
    multiplier_adjustment: float | None = None,
) -> DataFrame:
    """Matched wall edges per story with the length that counts.

    With ``boxes`` (``model_id, min_x, max_x, min_y, max_y``) an adiabatic wall
    counts, as a party wall, when it lies on the box or its space stands for
    itself only.
    """
    keys = ["model_id", "story_id", "space_id"]
    floors = surfaces.where(F.col("surface_type") == "Floor")
    walls = surfaces.where((F.col("surface_type") == "Wall") & F.col("boundary").isin(*boundaries))
    # A space without its row stands for itself once.
    matched = match_edges(edges(floors), edges_at_floors(walls, floors, keys), keys).join(
        spaces.select("model_id", "space_id", "multiplier"), ["model_id", "space_id"], "left"
    ).withColumn("multiplier", F.coalesce("multiplier", F.lit(1)))
    length, party = edge_length("p", "q"), F.lit(False)
    if boxes is not None:
        matched = matched.join(boxes, "model_id", "left")
        on_box = F.lit(False)
        for axis in ("x", "y"):
            for end in ("min", "max"):
                side = F.col(f"{end}_{axis}")
                on_box = on_box | (
                    (F.abs(side - F.col(f"p.{axis}")) < TOLERANCE)
                    & (F.abs(side - F.col(f"q.{axis}")) < TOLERANCE)
                )
        adiabatic = F.col("boundary") == "Adiabatic"
        party = adiabatic & (F.coalesce(on_box, F.lit(False)) | (F.col("multiplier") == 1))
        length = F.when(adiabatic & ~party, F.lit(0.0)).otherwise(length)
    if multiplier_adjustment is not None:
        length = length * (F.col("multiplier") / F.lit(float(multiplier_adjustment)))
    return matched.select(
        *keys, "surface_id", length.alias("length"), party.alias("party_wall")
    )


def story_perimeter(story: DataFrame) -> DataFrame:
    """Perimeter per story and how many of its edges are party walls."""
    return story.groupBy("model_id", "story_id").agg(
        F.sum("length").alias("perimeter"), F.count_if("party_wall").alias("n_party_edges")
    )


def party_walls(story: DataFrame) -> DataFrame:
    return story.where("party_wall").select("model_id", "story_id", "surface_id").distinct()


def bounding_boxes(surfaces: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    (x0, x1), (y0, y1) = extent("x"), extent("y")
    return surfaces.groupBy(*keys).agg(
        F.min(x0).alias("min_x"), F.max(x1).alias("max_x"), F.min(y0).alias("min_y"), F.max(y1).alias("max_y")
    )


def estimate_perimeter(
    surfaces: DataFrame, keys: Sequence[str] = ("model_id", "story_id")
) -> DataFrame:
    """Area over height of the exterior walls; level ones are left out."""
    low, high = extent("z")
    walls = surfaces.where((F.col("surface_type") == "Wall") & (F.col("boundary") == "Outdoors"))
    return (
        walls.withColumn("_height", high - low).where(F.col("_height") > 0)
        .groupBy(*keys).agg(F.sum(F.col("gross_area") / F.col("_height")).alias("perimeter"))
    )


def by_area_largest_first(
    space_types: DataFrame, keys: Sequence[str] = ("model_id",), area: str = "floor_area", name: str = "space_type"
) -> DataFrame:
    """The largest first, the rest by growing area."""
    largest = space_types.groupBy(*keys).agg(F.max(F.struct(area, name)).alias("_top"))
    return (
        space_types.join(largest, list(keys))
        .withColumn("is_largest", F.struct(area, name) == F.col("_top"))
        .drop("_top")
        .orderBy(*keys, F.col("is_largest").desc(), area, name)
    )
