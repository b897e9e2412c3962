"""Space types over stories, and running sums in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from demandloom.operators import stories
from demandloom.operators.prefix import running_sum
from tests.plan_audit import marks, plan_of

TYPES = "model_id string, space_type string, type_order long, floor_area double"
STORIES = "model_id string, story_no long, story_area double, min_area double"


def laid(spark, types, levels, **options):
    df = stories.lay_over_stories(spark.createDataFrame(types, TYPES), spark.createDataFrame(levels, STORIES), **options)
    return {(r.model_id, r.story_no, r.space_type): round(r.area, 6) for r in df.collect()}


def plain(types, levels):
    """The layout of one model, unit of area by unit of area: the line as a list."""
    line = [t for _, t, _, area in sorted(types, key=lambda r: r[2]) for _ in range(int(area))]
    owner, starts = [], []
    for _, number, area, _ in sorted(levels, key=lambda r: r[1]):
        starts.append(len(owner))
        owner += [number] * int(area)
    out = owner[: len(line)] + [None] * (len(line) - len(owner))
    levels = sorted(levels, key=lambda r: r[1])
    for (_, number, area, least), (_, above, next_area, _), s0 in zip(levels, levels[1:], starts):
        s1 = s0 + int(area)
        if s1 >= len(line) or not 0 < s1 or line[s1 - 1] != line[s1]:
            continue
        a0, a1 = line.index(line[s1]), len(line) - line[::-1].index(line[s1])
        if a1 - a0 < least:
            continue
        head, tail = s1 - max(a0, s0), a1 - s1
        if head < least:
            swap = min(5 * least, tail - least, area / 2 - head, next_area / 2)
            parts = [(a0 - swap, a0, above), (a0, s1 + swap, number)]
        elif tail < least:
            swap = min(5 * least, head - least, area / 2, next_area / 2 - tail)
            parts = [(s1 - swap, a1, above), (a1, a1 + swap, number)]
        else:
            continue
        if swap >= least:
            for a, b, to in parts:
                for i in range(int(a), min(int(b), len(line))):
                    out[i] = to
    found = {}
    for number, t in zip(out, line):
        found[number, t] = found.get((number, t), 0) + 1
    return found


def test_types_are_cut_where_stories_end(spark):
    types = [("m", "a", 1, 60.0), ("m", "b", 2, 70.0), ("m", "c", 3, 80.0)]
    levels = [("m", 1, 100.0, 1.0), ("m", 2, 90.0, 1.0)]
    assert laid(spark, types, levels) == {
        ("m", 1, "a"): 60, ("m", 1, "b"): 40, ("m", 2, "b"): 30, ("m", 2, "c"): 60, ("m", None, "c"): 20,
    }


def test_slivers_are_traded_away(spark):
    # b has just begun when the story ends: it takes 20 more from the next one, for 20 of a
    types = [("m", "a", 1, 97.0), ("m", "b", 2, 103.0)]
    levels = [("m", 1, 100.0, 4.0), ("m", 2, 100.0, 4.0)]
    assert laid(spark, types, levels) == {("m", 1, "a"): 77, ("m", 1, "b"): 23, ("m", 2, "a"): 20, ("m", 2, "b"): 80}
    # 3 of a are left for the next story: it gets 20 more, for 20 of b
    types = [("m", "a", 1, 103.0), ("m", "b", 2, 97.0)]
    assert laid(spark, types, levels) == {("m", 1, "a"): 80, ("m", 1, "b"): 20, ("m", 2, "a"): 23, ("m", 2, "b"): 77}
    # a type smaller than a sliver stays one
    types = [("m", "a", 1, 98.0), ("m", "b", 2, 3.0), ("m", "c", 3, 99.0)]
    assert laid(spark, types, levels)["m", 1, "b"] == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_against_units_of_area(spark, seed):
    rng = random.Random(seed)
    types, levels = [], []
    for m in range(60):
        n = rng.randint(0, 5)
        types += [(f"m{m}", f"t{i}", i, float(rng.choice((0, 1, 3, 40, 200)) + rng.randrange(9))) for i in range(rng.randint(0, 7))]
        levels += [(f"m{m}", i, float(2 * rng.randint(0, 120)), 4.0) for i in range(1, n + 1)]
    want = {}
    for m in range(60):
        own = [r for r in types if r[0] == f"m{m}"]
        want |= {(f"m{m}", *k): v for k, v in plain(own, [r for r in levels if r[0] == f"m{m}"]).items()}
    assert laid(spark, types, levels) == want == laid(spark, types, levels, block=2)


def test_awkward_tables(spark):
    types = [("m", "a", 1, None), ("m", "b", None, 5.0), ("m", "c", 3, -4.0), ("m", "d", 3, 1.0), ("x", "a", 1, 2.0)]
    levels = [("m", 1, None, 1.0), ("m", 2, 6.0, None), ("gone", 1, 9.0, 1.0)]
    assert laid(spark, types, levels) == {("m", 2, "b"): 5, ("m", 2, "d"): 1, ("x", None, "a"): 2}
    assert laid(spark, types[:0], levels) == {}
    assert laid(spark, types, levels[:0]) == {("m", None, "b"): 5, ("m", None, "d"): 1, ("x", None, "a"): 2}


def test_intervals_meet_in_cells(spark):
    df = stories.lay_over_stories(spark.createDataFrame([], TYPES), spark.createDataFrame([], STORIES))
    found = marks(plan_of(df))
    assert not {"cartesian", "nested", "python", "single"} & set(found)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_sum(spark, block):
    rng = random.Random(block)
    table = [(rng.choice("ab"), rng.choice([None, *range(-9, 9)]), i, rng.randrange(100)) for i in range(200)]
    df = spark.createDataFrame(table, "k string, at long, id long, v long")
    got = {r.id: r.total for r in running_sum(df, ["k"], "at", F.col("v"), "total", ["id"], block).collect()}
    want = {}
    for k in "ab":
        total = 0
        for _, at, i, v in sorted((r for r in table if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            total += v
            want[i] = total
    assert got == want
