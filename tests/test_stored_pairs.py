"""Stored baselines and scenarios: pairing without moving rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from demandloom.operators import metrics
from demandloom.sources.stored_pairs import write_pairs
from tests.plan_audit import plan_of

METER = "run_id string, ts timestamp_ntz, oat_f double, bldg_kw double"
COLUMNS = ["run_id", "baseline_id", "ts", "oat_f", "base_kw", "floor_area", "scenario_kw"]


def runs(spark, names, gaps, seed):
    rng = random.Random(seed)
    rows = [(name, i, 50.0 + i, rng.random() * 9) for name in names for i in range(40) if (name, i % 10) not in gaps]
    table = spark.createDataFrame(rows, "run_id string, i int, oat_f double, bldg_kw double")
    time = F.timestamp_add("MINUTE", F.col("i") * 15, F.lit("2017-05-01").cast("timestamp_ntz"))
    return table.select("run_id", time.alias("ts"), "oat_f", "bldg_kw")


@pytest.fixture
def tables(spark):
    base = runs(spark, ["b1", "b2", "lonely"], {("b2", 3)}, 1)
    scen = runs(spark, ["s1", "s2", "s3", "unlinked"], {("s1", 2), ("s1", 3), ("s2", 7)}, 2)
    link = spark.createDataFrame(
        [("s1", "b1", 100.0), ("s2", "b1", 200.0), ("s3", "b2", 300.0), ("s4", "b2", 400.0), ("s5", "gone", 1.0)],
        "run_id string, baseline_id string, floor_area double",
    )  # s4 has no rows at all
    return base, scen, link


def test_same_pairs_as_without_storage(spark, tables, tmp_path, rows):
    base, scen, link = tables
    pairs = write_pairs(base, scen, link, str(tmp_path / "p"), buckets=5)
    got = metrics.pair_stored(pairs.table(spark, "baseline"), pairs.table(spark, "scenario"), pairs.link(spark))
    assert rows(got, *COLUMNS) == rows(metrics.pair_with_baseline(base, scen, link), *COLUMNS)


def test_repeated_and_null_rows(spark, tables, tmp_path, rows):
    base, scen, link = tables
    base = base.unionByName(base.where("run_id = 'b1'").limit(3))
    base = base.unionByName(spark.createDataFrame([("b1", None, 1.0, 2.0)], METER))
    scen = scen.unionByName(scen.where("run_id = 's1'").limit(2)).unionByName(spark.createDataFrame([("s1", None, 1.0, 2.0)], METER))
    pairs = write_pairs(base, scen, link, str(tmp_path / "p"), buckets=3)
    got = metrics.pair_stored(pairs.table(spark, "baseline"), pairs.table(spark, "scenario"), pairs.link(spark))
    assert rows(got, *COLUMNS) == rows(metrics.pair_with_baseline(base, scen, link), *COLUMNS)
    nothing = write_pairs(base.limit(0), scen, link, str(tmp_path / "q"), buckets=3)
    assert metrics.pair_stored(nothing.table(spark, "baseline"), nothing.table(spark, "scenario"), link).count() == 0


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_rows_meet_without_an_exchange(spark, tables, tmp_path, threshold):
    base, scen, link = tables
    pairs = write_pairs(base, scen, link, str(tmp_path / "p"), buckets=4)
    baseline, scenario = (pairs.table(spark, kind).where("month(ts) = 5") for kind in ("baseline", "scenario"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        met = baseline.drop("n_runs").join(scenario.hint("merge"), list(metrics.PAIR_KEYS))
        assert "Exchange" not in plan_of(met) and "Bucketed: true" in met._jdf.queryExecution().toString()
        plan = plan_of(metrics.pair_stored(baseline, scenario, pairs.link(spark)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # No row is placed anew by its time; only what lacks scenarios goes on to their list, by its baseline.
    by_time = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\([^)]*ts#", line)]
    assert by_time == []


def test_one_file_per_bucket(spark, tables, tmp_path):
    base, scen, link = tables
    write_pairs(base, scen, link, str(tmp_path / "p"), buckets=4)
    files = sorted(p.name for p in (tmp_path / "p" / "scenario").glob("*.parquet"))
    assert sorted(re.search(r"_(\d{5})\.", name)[1] for name in files) == ["00000", "00001", "00002", "00003"]
