"""Points of spaces against the floors of their space, on any plane.

A point is projected along the normal of a floor's plane, and counts where it lands in the floor's polygon or
within a tolerance of its edges. Floors that face one way share two axes, on which the projection does not depend on
how far the plane is; so each point gets its place once per facing, and points and floors meet in cells of these axes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.geometry import vertex

TOLERANCE = 0.01
# A floor lies in at most this many cells to a side; so many floors of a space and facing are one cell.
MOST_CELLS = 256
FEW_FLOORS = 8
# Rings of up to so many corners are written out.
SMALL = 4
FACING = ["_fx", "_fy", "_fz"]
BOUNDS = ["_a0", "_a1", "_b0", "_b1"]


Place = Column | dict[str, Column]


def _dot(a: Place, b: Place) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _cross(a: Place, b: Place) -> dict[str, Column]:
    parts = a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]
    return dict(zip("xyz", parts))


def _parts(place: Column, fields: Sequence[str] = "xyz") -> dict[str, Column]:
    return {f: place[f] for f in fields}


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*(part.alias(f) for f, part in parts.items()))


def _with_next(ring: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn`` of each corner and the one after it."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), fn)


def _sum(parts: Column, fields: Sequence[str]) -> Column:
    zero = F.struct(*(F.lit(0.0).alias(f) for f in fields))
    return F.aggregate(parts, zero, lambda a, p: F.struct(*((a[f] + p[f]).alias(f) for f in fields)))


def _small(ring: Column) -> Column:
    """Whether the ring has three or four corners, as most have: these are written out, for lambdas take ten times as long."""
    return F.size(ring).between(3, SMALL)


def _corners(ring: Column) -> list[Column]:
    """The corners of a :func:`_small` ring; a triangle's first one comes again."""
    first, *others, last = (F.get(ring, F.lit(i)) for i in range(SMALL))
    return [first, *others, F.when(F.size(ring) == SMALL, last).otherwise(first)]


def _sum_of_fan(ring: Column, fn: Callable[[Place, Place], dict[str, Column]], fields: Sequence[str]) -> Column:
    """Sums of ``fn`` of the two far corners, as seen from the first one, of each triangle around the first corner."""
    first, *others = map(_parts, _corners(ring))

    def seen(v: Place) -> Place:
        return {c: v[c] - first[c] for c in "xyz"}

    far = [seen(v) for v in others]
    parts = [fn(v, w) for v, w in zip(far, far[1:])]
    written = _struct({f: sum((p[f] for p in parts[1:]), start=parts[0][f]) for f in fields})
    n = F.greatest(F.size(ring) - 2, F.lit(0))
    fan = F.zip_with(F.slice(ring, F.lit(2), n), F.slice(ring, F.lit(3), n), lambda v, w: _struct(fn(seen(v), seen(w))))
    return F.when(_small(ring), written).otherwise(_sum(fan, fields))


def area_vector(ring: Column) -> Column:
    """Along the normal, right-handed around the ring, and twice as long as the area; of a closed ring on a plane."""
    return _sum_of_fan(ring, _cross, "xyz")


def with_normal(surfaces: DataFrame, name: str) -> DataFrame:
    """The unit normal of ``vertices``, null for a ring without area. Digits beyond the ninth go, so that floors on one plane face the same way."""
    sized = surfaces.withColumn("_area", area_vector(F.col("vertices")))
    sized = sized.withColumn("_length", F.sqrt(_dot(F.col("_area"), F.col("_area"))))
    # Adding zero turns a negative zero into zero.
    unit = vertex(*(F.rint(F.col("_area")[c] / F.col("_length") * 1e9) / 1e9 + 0.0 for c in "xyz"))
    return sized.withColumn(name, F.when(F.col("_length") > 1e-9, unit)).drop("_area", "_length")


def centroid(ring: Column, n: Column) -> Column:
    """``w`` and ``x, y, z``, the centre of area as seen from the first corner times ``3 * w``: triangles weighted by their area along the normal ``n``."""
    normal = _parts(n)

    def part(a: Place, b: Place) -> dict[str, Column]:
        weight = _dot(_cross(a, b), normal)
        return {"w": weight, **{c: weight * (a[c] + b[c]) for c in "xyz"}}

    return _sum_of_fan(ring, part, "wxyz")


def window_points(
    windows: DataFrame, floors: DataFrame, inward: Column, height: float, keys: Sequence[str] = ("model_id", "space_id")
) -> DataFrame:
    """``windows`` (``vertices``) with ``x, y, z``: ``inward`` from the window's centre, then ``height`` above the reference floor's plane.

    ``floors`` has one reference floor (``vertices``) per space. Floors look down, windows out of the space. The point is null
    for a window or floor without area and for a space without reference floor.
    """
    first = F.get("vertices", F.lit(0))
    planes = with_normal(floors, "_down").select(*keys, "_down", first.alias("_on"))
    centred = with_normal(windows, "_out").withColumn("_sum", centroid(F.col("vertices"), F.col("_out")))
    centre = {c: first[c] + F.when(F.col("_sum.w") > 0, F.col("_sum")[c] / (F.col("_sum.w") * 3)) for c in "xyz"}
    start = {f"_s{c}": centre[c] - F.col("_out")[c] * inward for c in "xyz"}
    placed = centred.withColumns(start).join(planes, list(keys), "left")
    down, on = F.col("_down"), F.col("_on")
    above = sum((F.col(f"_s{c}") * down[c] for c in "xyz"), start=-_dot(on, down))
    placed = placed.withColumn("_off", -above - F.lit(float(height)))
    point = {c: F.col(f"_s{c}") + down[c] * F.col("_off") for c in "xyz"}
    return placed.withColumns(point).drop("_sum", "_out", "_down", "_on", "_off", *start)


# --- points on floors ------------------------------------------------------


def _axes(n: Column) -> tuple[Column, Column]:
    """Two unit vectors at right angles to the normal and to each other."""
    lying = F.abs(n["z"]) >= 0.5
    long = F.when(lying, F.hypot(n["x"], n["z"])).otherwise(F.hypot(n["x"], n["y"]))
    zero = F.lit(0.0)
    u = vertex(
        F.when(lying, n["z"]).otherwise(-n["y"]) / long, F.when(lying, zero).otherwise(n["x"]) / long,
        F.when(lying, -n["x"]).otherwise(zero) / long,
    )
    w = vertex(n["y"] * u["z"] - n["z"] * u["y"], n["z"] * u["x"] - n["x"] * u["z"], n["x"] * u["y"] - n["y"] * u["x"])
    return u, w


def _flat_floors(floors: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Floors with the ring on the axes of their facing, and its bounds."""
    faced = with_normal(floors.select(*keys, "surface_id", "vertices"), "_normal")
    # Unfolded, so that no filter on what follows from the normal works the normal out again below.
    faced = faced.withColumn("_normal", F.explode_outer(F.array("_normal"))).where(F.col("_normal").isNotNull())
    # Whole numbers as keys: billionths of the normal.
    faced = faced.withColumns({f"_f{c}": F.rint(F.col("_normal")[c] * 1e9).cast("long") for c in "xyz"})
    u, w = _axes(F.col("_normal"))
    axed = faced.withColumns({"_u": u, "_w": w}).drop("_normal")

    u, w = _parts(F.col("_u")), _parts(F.col("_w"))

    def place(v: Place) -> Column:
        return _struct({"a": _dot(v, u), "b": _dot(v, w)})

    written = F.array(*map(place, _corners(F.col("vertices"))))
    ring = F.when(_small(F.col("vertices")), written).otherwise(F.transform("vertices", place))
    flat = axed.withColumn("_ring", ring).drop("vertices")
    bounds = {}
    for axis in ("a", "b"):
        values = F.col(f"_ring.{axis}")
        bounds |= {f"_{axis}0": F.array_min(values) - tolerance, f"_{axis}1": F.array_max(values) + tolerance}
    return flat.withColumns(bounds)


def _lands(a: Column, b: Column, ring: Column, tolerance: float) -> Column:
    """Whether the place lies in the polygon (an odd number of edges to one side) or within the tolerance of an edge."""
    def crosses(p: Place, q: Place) -> Column:
        spans = (p["b"] > b) != (q["b"] > b)
        return F.when(spans, a < p["a"] + (b - p["b"]) / (q["b"] - p["b"]) * (q["a"] - p["a"])).otherwise(False)

    def near(p: Place, q: Place) -> Column:
        da, db = q["a"] - p["a"], q["b"] - p["b"]
        square = da * da + db * db
        t = F.when(square > 0, ((a - p["a"]) * da + (b - p["b"]) * db) / square).otherwise(0.0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(p["a"] + t * da - a, p["b"] + t * db - b) <= tolerance

    corners = [_parts(v, "ab") for v in _corners(ring)]
    pairs = list(zip(corners, [*corners[1:], corners[0]]))
    written = reduce(Column.__ne__, (crosses(*e) for e in pairs)) | reduce(Column.__or__, (near(*e) for e in pairs))
    edges = _with_next(ring, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    odd = F.size(F.filter(edges, lambda e: crosses(e["p"], e["q"]))) % 2 == 1
    return F.when(_small(ring), written).otherwise(odd | F.exists(edges, lambda e: near(e["p"], e["q"])))


def points_on_floors(
    points: DataFrame, floors: DataFrame, keys: Sequence[str] = ("model_id", "space_id"), point_id: str = "point_id",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(keys, point_id, n_floors, floor_id, on_floor)`` for each point.

    ``points``: ``keys``, ``point_id`` and ``x, y, z``; ``floors``: ``keys``, ``surface_id``, ``vertices``. ``n_floors`` is the
    number of floors of the space that the point lands on, ``floor_id`` the least of them. A point in a space without floors is
    on none; without coordinates it is on none and ``on_floor`` is null. Floors without area have no plane and are left out. Rows of
    one point id count together: on a floor when one of them is. Keys are not null.

    A cell is as wide as the mean floor of its space and facing, and at least a 256th of the widest; a few floors are in one cell.
    """
    keys = list(keys)
    faced, place = [*keys, *FACING], ["_cell_a", "_cell_b"]
    flat = _flat_floors(floors, keys, tolerance)
    extent = F.greatest(F.col("_a1") - F.col("_a0"), F.col("_b1") - F.col("_b0"))
    width = F.when(F.count(F.lit(1)) > FEW_FLOORS, F.greatest(F.avg(extent), F.max(extent) / MOST_CELLS)).otherwise(math.inf)
    widths = flat.groupBy(*faced).agg(width.alias("_width"), F.first("_u").alias("_u"), F.first("_w").alias("_w"))

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / F.col("_width")), F.floor(F.col(high) / F.col("_width"))))

    # Unfolded rows are more than their estimate says, so no side is offered for broadcast; hot spaces are split as they run.
    celled = flat.join(widths.select(*faced, "_width"), faced).withColumn("_cell_a", cells("_a0", "_a1")).withColumn("_cell_b", cells("_b0", "_b1"))
    celled = celled.select(*faced, *place, "surface_id", "_ring", *BOUNDS)

    axes = {"_a": "_u", "_b": "_w"}
    seen = points.select(*keys, point_id, "x", "y", "z").join(widths.hint("merge"), keys, "left")
    seen = seen.withColumns({k: sum((F.col(c) * F.col(axis)[c] for c in "yz"), start=F.col("x") * F.col(axis)["x"]) for k, axis in axes.items()})
    placed = seen.withColumns({f"_cell{k}": F.floor(F.col(k) / F.col("_width")) for k in axes}).drop("_u", "_w", "_width")
    # Edges are tested only where the place is in the bounds.
    near = F.col("_a").between(F.col("_a0"), F.col("_a1")) & F.col("_b").between(F.col("_b0"), F.col("_b1"))
    lands = F.when(near, _lands(F.col("_a"), F.col("_b"), F.col("_ring"), tolerance))
    met = placed.join(celled.hint("merge"), [*faced, *place], "left")
    known = reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(c) for c in "xyz"))
    counted = met.select(*keys, point_id, F.when(lands, F.col("surface_id")).alias("_floor"), known.alias("_known")).groupBy(*keys, point_id).agg(
        F.count_distinct("_floor").alias("n_floors"), F.min("_floor").alias("floor_id"), F.max("_known").alias("_known")
    )
    return counted.select(*keys, point_id, "n_floors", "floor_id", F.when(F.col("_known"), F.col("n_floors") > 0).alias("on_floor"))
