"""Profiles and schedules by content."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from demandloom.functions import profiles as P
from demandloom.operators import shared
from tests.plan_audit import plan_of

PROFILES = "profile_id string, points array<struct<until_min: int, value: double>>"


def test_needless_breakpoints_do_not_count(spark):
    nan = float("nan")
    days = {
        "a": [(480, 1.0), (1440, 2.0)],
        "b": [(240, 1.0), (480, 1.0), (900, 2.0), (1440, 2.0)],
        "c": [(480, 1.0), (1440, 3.0)],
        "zero": [(1440, 0.0)], "minus zero": [(600, 0.0), (1440, -0.0)],
        "nan": [(600, nan), (1440, nan)], "nan too": [(1440, nan)],
        "unset": [(600, None), (1440, None)], "unset too": [(1440, None)],
        "empty": [], "none": None,
    }
    df = spark.createDataFrame(list(days.items()), PROFILES)
    found = {r.profile_id: r.shape_id for r in shared.links(df).collect()}
    groups = defaultdict(set)
    for name, shape in found.items():
        groups[shape].add(name)
    assert sorted(map(sorted, groups.values())) == sorted(
        [["a", "b"], ["c"], ["minus zero", "zero"], ["nan", "nan too"], ["unset", "unset too"], ["empty"], ["none"]]
    )
    shapes = shared.dictionary(df)
    assert {r.shape_id: r.n_uses for r in shapes.collect()} == {shape: len(names) for shape, names in groups.items()}
    assert shared.colliding(shapes).count() == 0
    a_points = [r.points for r in shapes.collect() if r.shape_id == found["a"]]
    assert a_points == [[(480, 1.0), (1440, 2.0)]]
    assert shared.dictionary(df.limit(0)).count() == 0


def test_addresses_move_no_rows(spark):
    df = spark.createDataFrame([("a", [(1440, 1.0)])], PROFILES)
    assert "Exchange" not in plan_of(shared.links(df))


def test_a_collision_is_seen(spark):
    shapes = spark.createDataFrame(
        [("x", [(1440, 1.0)], 1), ("x", [(1440, 2.0)], 1), ("y", [(1440, 2.0)], 1)],
        "shape_id string, points array<struct<until_min: int, value: double>>, n_uses long",
    )
    assert [tuple(r) for r in shared.colliding(shapes).collect()] == [("x", 2)]


def test_edit_of_the_dictionary_is_the_edit_of_all_profiles(spark):
    rng = random.Random(4)
    days = [
        (f"p{i}", [(t, float(rng.randrange(3))) for t in (360, 720)[: rng.randrange(3)]] + [(1440, float(rng.randrange(3)))])
        for i in range(200)
    ] + [(f"hot{i}", [(1440, 7.0)]) for i in range(100)]
    df = spark.createDataFrame(days, PROFILES)
    edit = P.edit_window(F.col("points"), 300, 900, lambda v: F.least(v, F.lit(1.0)))
    shapes = shared.dictionary(df)
    edited = shapes.withColumn("points", edit)
    want = {r.profile_id: r.points for r in df.select("profile_id", P.canonical(edit).alias("points")).collect()}
    plain = shared.expand(shared.links(df), edited).select("profile_id", P.canonical(F.col("points")).alias("points"))
    assert {r.profile_id: r.points for r in plain.collect()} == want

    owned, smaller = shared.readdress(shared.links(df), edited)
    assert {r.profile_id: r.points for r in shared.expand(owned, smaller).collect()} == want
    counts = Counter(tuple(map(tuple, p)) for p in want.values())
    assert {tuple(map(tuple, r.points)): r.n_uses for r in smaller.collect()} == counts
    assert smaller.count() < shapes.count()
    again = {r.shape_id for r in shared.dictionary(shared.expand(owned, smaller)).collect()}
    assert again == {r.shape_id for r in smaller.collect()}


ENTRIES = "schedule_id string, kind string, position int, shape_id string"


def test_schedules_with_the_same_entries(spark):
    rng = random.Random(5)
    rows = [
        (f"s{i:03}", rng.choice(["rule", "default", None]), rng.choice([0, 1, None]), rng.choice("ab"))
        for i in range(150) for _ in range(rng.randrange(4))
    ]
    rows += [(f"t{i:03}", "default", 0, "a") for i in range(60)] + [(None, "default", 0, "a")]
    rows += [("u1", "default", 0, "a"), ("u1", "default", 0, "a"), ("u2", None, 0, "a"), ("u3", "", 0, "a")]
    rng.shuffle(rows)
    got = dict(map(tuple, shared.same_schedules(spark.createDataFrame(rows, ENTRIES), ("kind", "position", "shape_id")).collect()))
    content = defaultdict(Counter)
    for key, *entry in rows:
        if key is not None:
            content[key][tuple(entry)] += 1
    first = {}
    for key in sorted(content):
        first.setdefault(frozenset(content[key].items()), key)
    assert got == {key: first[frozenset(c.items())] for key, c in content.items()}
    assert got["u1"] != got["t000"] and got["u2"] != got["u3"]
    assert shared.same_schedules(spark.createDataFrame([], ENTRIES), ("kind",)).count() == 0


def test_proposals_are_verified(spark, monkeypatch):
    """With a hash that is the same for all, only what is really equal to the first is shared."""
    rows = [("a", "default", 0, "x"), ("b", "default", 0, "y"), ("c", "default", 0, "x"), ("d", "rule", 0, "x")]
    monkeypatch.setattr(shared.F, "xxhash64", lambda *columns: F.lit(1))
    got = shared.same_schedules(spark.createDataFrame(rows, ENTRIES), ("kind", "position", "shape_id"))
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("b", "b"), ("c", "a"), ("d", "d")]


def test_only_proposals_with_differences_are_looked_up(spark, monkeypatch):
    """Also with one hash for all: the pairs agree, of the single ones some have their entry twice."""
    rows = [(s, "default", 0, "x") for s in ("a", "a", "b", "c", "c", "d")]
    rows += [(s, "rule", p, "y") for s in ("p", "q") for p in (0, None)]
    monkeypatch.setattr(shared.F, "xxhash64", lambda *columns: F.lit(1))
    got = shared.same_schedules(spark.createDataFrame(rows, ENTRIES), ("kind", "position", "shape_id"))
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("b", "b"), ("c", "a"), ("d", "d"), ("p", "p"), ("q", "p")]


def test_entries_stay_in_as_many_tasks_as_shuffles_start_from(spark):
    """Joined to larger ones, they need many times the size of their shuffle in memory."""
    df = spark.range(4000).selectExpr("cast(id as string) schedule_id", "'rule' kind", "0 position", "repeat(cast(id % 7 as string), 64) shape_id")
    got = shared.same_schedules(df, ("kind", "position", "shape_id"))
    assert got.groupBy("shared_id").count().count() == 7
    exchanges = [line for line in plan_of(got).splitlines() if "Exchange hashpartitioning(schedule_id" in line]
    assert any("REPARTITION_BY_NUM" in line for line in exchanges)


def test_no_join_looks_for_nulls_below_the_edits(spark):
    df = spark.createDataFrame([("a", [(480, 1.0), (1440, 2.0)])], PROFILES)
    edited = shared.dictionary(df).withColumn("points", P.map_values(F.col("points"), lambda v: v + 1))
    plan = plan_of(shared.expand(*shared.readdress(shared.links(df), edited)))
    assert "sha2" in plan and not any("sha2" in line for line in plan.splitlines() if "Filter " in line)
