"""Series to variable intervals and back; exact quantiles by refinement."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import quantiles, series
from tests.plan_audit import plan_of

STEPS = "k string, step long, value double"
RUNS = "k string, begin_step long, end_step long, value double"


def plain(rows):
    out = []
    for key, group in itertools.groupby(sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        for _, step, value in group:
            if out and out[-1][0] == key and out[-1][2] == step - 1 and out[-1][3] == value:
                out[-1][2] = step
            else:
                out.append([key, step, step, value])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("blocks", [(4,), (4, 16), (2, 8, 64), series.BLOCKS])
def test_runs_cross_blocks(spark, rows, blocks):
    rng = random.Random(5)
    data = [("flat", s, 1.0) for s in range(-37, 90)]
    data += [("none", s, None) for s in range(20)] + [("one", 7, 3.0), ("one", None, 3.0)]
    value = 0.0
    for s in range(300):
        value = value if rng.random() < 0.8 else float(rng.randrange(3))
        if rng.random() < 0.97:
            data.append(("mixed", s, value))
    rng.shuffle(data)
    df = spark.createDataFrame(data, STEPS).repartition(7)
    runs = series.to_intervals(df, ["k"], blocks=blocks)
    assert rows(runs, "k", "begin_step", "end_step", "value") == plain(data)
    back = series.from_intervals(runs, ["k"], block=8)
    assert rows(back, "k", "step", "value") == sorted((r for r in data if r[1] is not None), key=str)


def test_alternating_steps_and_empty_series(spark, rows):
    data = [("a", s, float(s % 2)) for s in range(64)]
    runs = series.to_intervals(spark.createDataFrame(data, STEPS), ["k"], blocks=(4, 16))
    assert rows(runs, "k", "begin_step", "end_step", "value") == plain(data)
    assert series.to_intervals(spark.createDataFrame([], STEPS), ["k"]).count() == 0
    assert series.from_intervals(spark.createDataFrame([("a", 5, 4, 1.0)], RUNS), ["k"]).count() == 0


def test_runs_of_days_are_stitched_without_a_row_per_step(spark, rows):
    rng = random.Random(11)
    data = [("k", s, float(rng.random() < 0.1)) for s in range(-96, 960) if s // 48 != 3] + [("flat", s, None) for s in range(480)]
    days = [(k, d, list(g)) for (k, d), g in itertools.groupby(data, key=lambda r: (r[0], r[1] // 48))]
    within = [run for _, _, day in days for run in plain(day)]
    runs = series.stitch_runs(spark.createDataFrame(within, RUNS).repartition(5), ["k"], blocks=(96, 480), within=48)
    assert rows(runs, "k", "begin_step", "end_step", "value") == plain(data)


def test_no_window_over_a_whole_series(spark):
    """Raw steps only meet a window together with their block."""
    df = spark.createDataFrame([("a", 1, 1.0)], STEPS)
    windows = [line for line in plan_of(series.to_intervals(df, ["k"], blocks=(4,))).splitlines() if "Window [" in line or "windowspecdefinition" in line]
    assert windows and sum("_block" in line for line in windows) >= len(windows) / 2


def groups():
    rng = np.random.default_rng(3)
    yield "normal", rng.normal(5, 2, 3001)
    yield "wide", np.concatenate([10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-300, 300, 500))])
    yield "ties", np.repeat([1.0, 1.0, 2.0, 7.0], 250)
    yield "close", 1e9 + rng.integers(0, 2000, 1500) * 2.0**-20
    yield "zeros", np.array([0.0, -0.0, 0.0, 5e-324, -5e-324])
    yield "infinite", np.array([-np.inf, 1.0, 2.0, 3.0, np.inf, np.inf])
    yield "single", np.array([4.0])
    yield None, np.array([1.0, 2.0])


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_are_exact(spark, few):
    data = [(name, float(v)) for name, values in groups() for v in values] + [("single", None), ("single", math.nan), ("empty", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), few).collect()}
    assert set(got) == {name for name, _ in groups()}
    for name, values in groups():
        ordered, want = sorted(values), []
        for p in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0):
            at = p * (len(ordered) - 1)
            low, high, part = ordered[math.floor(at)], ordered[math.ceil(at)], at - math.floor(at)
            want.append(low if low == high else low * (1 - part) + high * part)
        assert got[name].n == len(values)
        assert got[name].q == want, name


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    (row,) = quantiles.exact_quantiles(df, [], "v").collect()
    assert (row.n, row.q) == (101, [25.0, 50.0, 75.0])
    assert quantiles.exact_quantiles(df.limit(0), [], "v").collect() == []
    assert quantiles.fleet_box_stats(df.withColumn("hour", F.lit(1)).limit(0), "v").collect() == []


def test_boxes_of_a_fleet(spark):
    data = [(1, float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]] + [(2, 5.0)] + [(None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(data, "hour int, v double")
    got = {r.hour: tuple(r)[1:] for r in quantiles.fleet_box_stats(df, "v").collect()}
    assert got[1] == (9, pytest.approx(136 / 9), 3.0, 5.0, 7.0, 1.0, 8.0, 1)
    assert got[2] == (1, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 0)
    assert got[None] == (2, 2.0, 1.5, 2.0, 2.5, 1.0, 3.0, 0)
