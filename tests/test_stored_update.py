"""Updates in place of stored tables."""

import random

import pytest

from demandloom.operators import requests
from demandloom.sources import stored_update as S
from tests.plan_audit import plan_of

METERS = "model_id long, name string, reporting_frequency string"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.glob("rows/*/*.parquet")}


@pytest.fixture
def meters(spark, tmp_path):
    rng = random.Random(8)
    rows = [(m, f"m{i}", rng.choice(["hourly", None])) for m in [0] * 3 + list(range(1, 9)) for i in range(9)]
    rows = list({(m, n): (m, n, f) for m, n, f in rows}.values()) + [(None, "m1", "hourly"), (3, None, "daily")]
    existing = spark.createDataFrame(rows, METERS)
    return existing, S.write_table(existing, str(tmp_path / "t"), ("model_id", "name"), buckets=40)


def test_only_touched_buckets_are_written(spark, meters, tmp_path, rows):
    existing, table = meters
    before = files(tmp_path / "t")
    wanted = spark.createDataFrame([(1, "m1", "daily"), (1, "m2", "hourly"), (99, "new", "monthly")], METERS)
    done = S.update(table, wanted, requests.upsert_meters)
    full = requests.upsert_meters(existing, wanted)
    assert rows(table.read(spark)) == rows(full.drop("action"))
    assert {(r.model_id, r.name): r.action for r in done.collect() if (r.model_id, r.name) in {(1, "m1"), (99, "new")}} == {
        (1, "m1"): "changed", (99, "new"): "added",
    }
    after = files(tmp_path / "t")
    touched = {r[0] for r in table.with_bucket(wanted).select(S.BUCKET).collect()}
    same = {name for name in before if int(name.split("=")[1].split("/")[0]) not in touched}
    assert same and all(after[name] == before[name] for name in same)
    assert set(before) - set(after) == set(before) - same


def test_untouched_folders_are_not_read(spark, meters):
    _, table = meters
    plans = []

    def merge(existing, changes):
        plans.append(plan_of(existing))
        return requests.upsert_meters(existing, changes)

    S.stage_update(table, spark.createDataFrame([(1, "m1", "daily")], METERS), merge)
    assert f"{S.BUCKET}#" in plans[0].split("PartitionFilters: [", 1)[1].split("]")[0]


def test_repeated_after_a_failure(spark, meters, rows):
    existing, table = meters
    wanted = spark.createDataFrame([(m, "m4", "daily") for m in range(12)], METERS)
    expected = rows(requests.upsert_meters(existing, wanted).drop("action"))
    staged = S.stage_update(table, wanted, requests.upsert_meters)
    assert rows(table.read(spark)) == rows(existing)  # nothing is published yet
    S.publish(table, spark, staged)
    S.publish(table, spark, staged)
    assert rows(table.read(spark)) == expected
    S.update(table, wanted, requests.upsert_meters)
    assert rows(table.read(spark)) == expected


def test_keys_of_another_type_find_their_bucket(spark, meters, rows):
    existing, table = meters
    wanted = spark.createDataFrame([(m, f"m{i}", "daily") for m in range(9) for i in range(9)], METERS.replace("long", "int"))
    S.update(table, wanted, requests.upsert_meters)
    assert rows(table.read(spark)) == rows(requests.upsert_meters(existing, wanted).drop("action"))


def test_nothing_to_change_and_nothing_stored(spark, meters, tmp_path, rows):
    existing, table = meters
    before = files(tmp_path / "t")
    assert S.update(table, existing.limit(0), requests.upsert_meters).count() == 0
    assert files(tmp_path / "t") == before
    empty = S.write_table(existing.limit(0), str(tmp_path / "e"), ("model_id", "name"), buckets=4)
    S.update(empty, existing.where("model_id = 1"), requests.upsert_meters)
    assert rows(empty.read(spark)) == rows(existing.where("model_id = 1"))
    with pytest.raises(ValueError):
        S.write_table(existing.selectExpr("*", "1 as _BUCKET"), str(tmp_path / "x"), ("name",))


def test_a_run_done_again(spark, tmp_path, rows):
    kind = "run_id string, ts int, kw double"
    old = spark.createDataFrame([(r, t, 1.0) for r in ("a", "b", "c", None) for t in range(50)], kind)
    table = S.write_table(old, str(tmp_path / "r"), ("run_id",), buckets=2)
    again = spark.createDataFrame([("b", 3, 2.0), ("b", 3, 2.0), (None, 4, 2.0), ("d", 5, 2.0)], kind)
    S.update(table, again, S.replace_groups(table))
    assert rows(table.read(spark)) == rows(old.where("run_id in ('a', 'c')").unionByName(again))
