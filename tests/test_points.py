"""Window points and the floors they land on."""

import math
import random

import pytest
from pyspark.sql import functions as F

from demandloom.operators import points
from tests.plan_audit import plan_of

RING = "array<struct<x:double,y:double,z:double>>"
FLOORS = f"model_id string, space_id long, surface_id long, vertices {RING}"
POINTS = "model_id string, space_id long, point_id long, x double, y double, z double"


def found(spark, spots, floors, **options):
    df = points.points_on_floors(spark.createDataFrame(spots, POINTS), spark.createDataFrame(floors, FLOORS), **options)
    return {(r.space_id, r.point_id): (r.n_floors, r.floor_id, r.on_floor) for r in df.collect()}


L_SHAPE = [(0.0, 0.0, 0.0), (0.0, 10.0, 0.0), (4.0, 10.0, 0.0), (4.0, 4.0, 0.0), (10.0, 4.0, 0.0), (10.0, 0.0, 0.0)]


def test_concave_floor_tolerance_and_missing(spark):
    spots = [
        ("m", 1, 1, 2.0, 8.0, 3.0), ("m", 1, 2, 8.0, 8.0, 0.0), ("m", 1, 3, 4.009, 9.0, 1.0), ("m", 1, 4, 4.011, 9.0, 1.0),
        ("m", 1, 5, 10.006, -0.006, 0.0), ("m", 1, 6, 10.008, -0.008, 0.0), ("m", 1, 7, None, 1.0, 1.0), ("m", 1, 8, math.nan, 1.0, 1.0),
        ("m", 2, 1, 2.0, 8.0, 3.0), ("m", 3, 1, 2.0, 8.0, 3.0),
    ]
    line = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)]
    got = found(spark, spots, [("m", 1, 11, L_SHAPE), ("m", 1, 12, L_SHAPE[::-1]), ("m", 3, 31, line), ("m", 3, 32, []), ("m", 3, 33, None)])
    yes, no = (2, 11, True), (0, None, False)
    assert got == {
        (1, 1): yes, (1, 2): no, (1, 3): yes, (1, 4): no, (1, 5): yes, (1, 6): no, (1, 7): (0, None, None), (1, 8): (0, None, None),
        (2, 1): no, (3, 1): no,
    }


def test_repeated_ids_count_together_and_empty_tables(spark):
    floors = [("m", 1, 11, L_SHAPE)]
    assert found(spark, [("m", 1, 1, 2.0, 2.0, 0.0), ("m", 1, 1, 3.0, 2.0, 0.0), ("m", 1, 1, 9.0, 9.0, 0.0)], floors) == {(1, 1): (1, 11, True)}
    assert found(spark, [("m", 1, 1, 2.0, 2.0, 0.0)], []) == {(1, 1): (0, None, False)}
    assert found(spark, [], floors) == {}


def brute(point, ring, tolerance=0.01):
    """Distance of the projection to the polygon, with vectors of the plane itself."""
    def minus(a, b):
        return [i - j for i, j in zip(a, b)]

    def cross(a, b):
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    def dot(a, b):
        return sum(i * j for i, j in zip(a, b))

    n = cross(minus(ring[1], ring[0]), minus(ring[2], ring[1]))
    n = [c / math.sqrt(dot(n, n)) for c in n]
    p = minus(point, [c * dot(minus(point, ring[0]), n) for c in n])
    turned = 0.0
    for a, b in zip(ring, ring[1:] + ring[:1]):
        along = minus(b, a)
        t = max(0.0, min(1.0, dot(minus(p, a), along) / dot(along, along)))
        if math.dist(p, [c + t * d for c, d in zip(a, along)]) <= tolerance:
            return True
        u, v = minus(a, p), minus(b, p)
        turned += math.atan2(dot(cross(u, v), n), dot(u, v))
    return abs(turned) > 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_any_plane_against_brute_force(spark, seed):
    rng = random.Random(seed)
    floors, spots = [], []
    for space in range(3):
        for surface in range(25):
            size = 300.0 if surface == 0 else rng.uniform(1, 9)
            # Two directions of the plane, and an L on them.
            u = [rng.uniform(-1, 1) for _ in range(3)]
            w = [rng.uniform(-1, 1) for _ in range(3)]
            if surface % 3 == 0:
                u[2] = w[2] = 0.0
            at = [rng.uniform(-10, 10) for _ in range(3)]
            shape = [(0, 0), (0, 1), (0.4, 1), (0.4, 0.4), (1, 0.4), (1, 0)]
            ring = [tuple(at[i] + size * (a * u[i] + b * w[i]) for i in range(3)) for a, b in shape]
            floors.append(("m", space, space * 100 + surface, ring))
        spots += [("m", space, no, *(rng.uniform(-15, 15) for _ in range(3))) for no in range(60)]
    want = {}
    for _, space, no, *xyz in spots:
        hit = [f for _, s, f, ring in floors if s == space and brute(xyz, ring)]
        want[space, no] = (len(hit), min(hit, default=None), bool(hit))
    assert found(spark, spots, floors) == want


def test_window_points_stand_on_the_floor(spark):
    wall = [(0.0, 0.0, 1.0), (6.0, 0.0, 1.0), (6.0, 0.0, 3.0), (0.0, 0.0, 3.0)]  # looks to negative y
    floor = [(0.0, 0.0, 0.0), (0.0, 9.0, 0.0), (6.0, 9.0, 0.0), (6.0, 0.0, 0.0)]  # looks down
    triangle = [(0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (0.0, 0.0, 3.0)]
    windows = spark.createDataFrame([("m", 1, 1, wall), ("m", 1, 2, triangle), ("m", 1, 3, triangle[:2]), ("m", 2, 4, wall)], FLOORS)
    placed = points.window_points(windows, spark.createDataFrame([("m", 1, 9, floor)], FLOORS), F.lit(2.0), 0.8)
    got = {r.surface_id: tuple(None if c is None else round(c, 9) for c in (r.x, r.y, r.z)) for r in placed.collect()}
    assert got == {1: (3, 2, 0.8), 2: (1, 2, 0.8), 3: (None,) * 3, 4: (None,) * 3}


def test_no_filter_works_a_normal_out_again(spark):
    floors = spark.createDataFrame([("m", 1, 11, L_SHAPE)], FLOORS).repartition(2)
    plan = plan_of(points.points_on_floors(spark.createDataFrame([("m", 1, 1, 2.0, 2.0, 0.0)], POINTS), floors))
    filters = [line for line in plan.splitlines() if "Filter " in line or line.startswith("Condition")]
    assert filters and not any("zip_with" in line for line in filters)


def test_rings_written_out_are_like_longer_ones(spark):
    """A corner more on an edge makes no difference, but takes the ring past the corners that are written out."""
    rng = random.Random(3)
    floors, longer, spots = [], [], []
    for surface in range(40):
        u, w = ([rng.uniform(-9, 9) for _ in range(3)] for _ in range(2))
        at = [rng.uniform(-5, 5) for _ in range(3)]
        shape = [(0, 0), (0, 1), (1, 1), (1, 0)] if surface % 2 else [(0, 0), (0, 1), (1, 0)]
        middle = [*shape[:1], (0, 0.5), *shape[1:]] + [(0.5, 0)] * (len(shape) == 3)
        for rows, corners in ((floors, shape), (longer, middle)):
            rows.append(("m", surface % 4, surface, [tuple(at[i] + a * u[i] + b * w[i] for i in range(3)) for a, b in corners]))
    spots = [("m", space, no, *(rng.uniform(-9, 9) for _ in range(3))) for space in range(4) for no in range(80)]
    got = found(spark, spots, floors)
    assert got == found(spark, spots, longer)
    assert got == {
        (s, no): (len(hit), min(hit, default=None), bool(hit))
        for _, s, no, *xyz in spots for hit in [[f for _, space, f, ring in floors if space == s and brute(xyz, ring)]]
    }
