"""Closed forms of the shed metrics."""

import datetime as dt

import pytest

from demandloom.functions.calendar import is_workday_in
from demandloom.operators import metrics, pairing
from demandloom.plans import studies
from pyspark.sql import functions as F

METER = "run_id string, ts timestamp_ntz, oat_f double, bldg_kw double"
START = dt.datetime(2017, 7, 3)  # a Monday


def series(spark, run, kw, days=5, oat=lambda d, h, q: 70.0 + d + h):
    rows = [
        (run, START + dt.timedelta(days=d, hours=h, minutes=15 * q), float(oat(d, h, q)), float(kw(d, h, q)))
        for d in range(days)
        for h in range(24)
        for q in range(4)
    ]
    return spark.createDataFrame(rows, METER)


def link(spark, area=1000.0):
    return spark.createDataFrame([("s", "b", area)], "run_id string, baseline_id string, floor_area double")


def test_units(spark):
    raw = spark.createDataFrame(
        [("a", START, 0.0, 900000.0), ("a", START, 100.0, float("nan"))],
        "run_id string, ts timestamp_ntz, oat_c double, elec_j double",
    )
    got = [(r.oat_f, r.bldg_kw) for r in metrics.to_meter(raw).collect()]
    assert got == [(32.0, 1.0), (212.0, None)]


def test_shed_is_the_difference_over_area(spark):
    base = series(spark, "b", lambda d, h, q: 100)
    scen = series(spark, "s", lambda d, h, q: 90)
    shed = studies.shed_intervals(base, scen, link(spark))
    row = shed.agg(F.min("shed_pct"), F.max("shed_w_ft2"), F.count("shed_pct")).first()
    assert tuple(row) == (0.1, 10.0, 480)


def test_baseline_rows_stay_without_a_scenario(spark):
    base = series(spark, "b", lambda d, h, q: 100, days=2)
    scen = series(spark, "s", lambda d, h, q: 90, days=1)
    paired = metrics.add_shed(metrics.pair_with_baseline(base, scen, link(spark)))
    assert paired.count() == 192
    assert paired.where("shed_pct is null").count() == 96


def test_zero_baseline_gives_null(spark):
    base = series(spark, "b", lambda d, h, q: 0, days=1)
    paired = metrics.add_shed(metrics.pair_with_baseline(base, base.withColumn("run_id", F.lit("s")), link(spark)))
    assert paired.where("shed_pct is not null").count() == 0


@pytest.mark.parametrize("spread", [1, 7])
def test_baseline_copies_do_not_depend_on_the_spread(spark, spread):
    base = series(spark, "b", lambda d, h, q: 100 + h).withColumnRenamed("run_id", "baseline_id")
    links = spark.createDataFrame(
        [("s1", "b", 10.0), ("s2", "b", 20.0)], "run_id string, baseline_id string, floor_area double"
    )
    copies = metrics.with_each_scenario(base, links, spread=spread)
    assert copies.count() == 960 and copies.distinct().count() == 960
    assert {(r.run_id, r.floor_area) for r in copies.collect()} == {("s1", 10.0), ("s2", 20.0)}


@pytest.mark.parametrize("blocks", [None, 1, 16])
def test_pair_all_is_the_full_product_once(spark, blocks):
    left, right = spark.range(100).toDF("a"), spark.range(37).toDF("b")
    paired = pairing.pair_all(left, right, blocks)
    assert paired.count() == 3700 and paired.distinct().count() == 3700


def test_dense_resample_shows_the_gap(spark):
    day = series(spark, "b", lambda d, h, q: h + q, days=1).where((F.hour("ts") < 2) | (F.hour("ts") > 3))
    got = {r.ts.hour: r.bldg_kw for r in metrics.resample_mean(day, ["bldg_kw"], densify=True).collect()}
    assert len(got) == 24 and got[1] == 2.5 and got[2] is None and got[3] is None
    assert metrics.resample_mean(day, ["bldg_kw"]).count() == 22


def test_workday_filter(spark):
    week = series(spark, "b", lambda d, h, q: 1, days=7)
    assert week.where(is_workday_in(F.col("ts"))).count() == 5 * 96
    assert week.where(is_workday_in(F.col("ts"), (1, 2))).count() == 0


def hourly(spark):
    """Shed grows by 2 per degree up to 75 F and by 0.5 above, at every hour."""
    rows = []
    for d in range(20):
        for h in (11, 12):
            x = 66.0 + d
            y = 2 * x + 1 if x <= 75 else 0.5 * x + 100
            rows.append(("s", START + dt.timedelta(days=d, hours=h), x, y))
    return spark.createDataFrame(rows, "run_id string, ts timestamp_ntz, oat_f double, shed_w_ft2 double")


def test_piecewise_fit_finds_both_lines(spark):
    fit = {(r.hour, r.segment): r for r in metrics.piecewise_fit(hourly(spark)).collect()}
    assert set(fit) == {(h, s) for h in (11, 12) for s in ("low", "high")}
    low, high = fit[(11, "low")], fit[(11, "high")]
    assert (low.n, high.n, low.panel_hour) == (10, 10, 12)
    assert low.slope == pytest.approx(2) and low.intercept == pytest.approx(1)
    assert high.slope == pytest.approx(0.5) and high.intercept == pytest.approx(100)
    assert (low.x_min, low.x_max, high.x_max) == (66.0, 75.0, 85.0)


def test_single_point_has_no_slope(spark):
    one = hourly(spark).where("oat_f = 66")
    assert all(r.slope is None for r in metrics.piecewise_fit(one).collect())


def test_fit_line_meets_the_break(spark):
    line = metrics.fit_line(metrics.piecewise_fit(hourly(spark)).where("hour = 11"))
    assert line.count() == 200
    at_break = line.where("abs(x - 75) < 1e-9").select("segment", F.round("y", 6)).collect()
    assert sorted(tuple(r) for r in at_break) == [("high", 137.5), ("low", 151.0)]


def test_box_stats_match_hand_values(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    cells = spark.createDataFrame(
        [("s", f"d{i}", 9, v) for i, v in enumerate(values)],
        "run_id string, day string, hour int, shed_w_ft2 double",
    )
    row = metrics.box_stats(cells).first()
    assert (row.q1, row.median, row.q3) == (2.0, 3.0, 4.0)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (1.0, 4.0, 1)
    assert [r.shed_w_ft2 for r in metrics.box_outliers(cells).collect()] == [100.0]


def test_pivot_and_day_keys(spark):
    two_months = spark.createDataFrame(
        [("s", dt.datetime(2017, 7, 3, 9), 1.0), ("s", dt.datetime(2017, 8, 3, 9), 3.0)],
        "run_id string, ts timestamp_ntz, shed_w_ft2 double",
    )
    assert metrics.day_hour_pivot(two_months).count() == 2
    merged = metrics.day_hour_pivot(two_months, day="year_dom").first()
    assert (merged.day, merged.h09, merged.h10) == ("2017-03", 2.0, None)
    with pytest.raises(ValueError):
        metrics.day_hour_pivot(two_months, day="week")


def test_peak(spark):
    assert metrics.peak_shed(hourly(spark)).first().peak_shed_w_ft2 == pytest.approx(151.0)


def test_studies_run_end_to_end(spark):
    base = series(spark, "b", lambda d, h, q: 100)
    scen = series(spark, "s", lambda d, h, q: 100 - h)
    box = {r.hour: r.median for r in studies.shed_box_study(base, scen, link(spark)).collect()}
    assert box == {h: float(h) for h in range(24)}
    assert studies.shed_fit_study(base, scen, link(spark)).count() > 24


def test_hourly_study_equals_means_of_the_intervals(spark, rows):
    base = series(spark, "b", lambda d, h, q: 100 + h + q)
    part = series(spark, "s", lambda d, h, q: 90 - q).where((F.hour("ts") > 3) & (F.minute("ts") < 45))
    extra = series(spark, "s", lambda d, h, q: 1).withColumn("ts", F.expr("ts + interval 5 minutes")).limit(7)
    scen = part.unionByName(extra)  # the extra rows have no baseline interval
    slow = metrics.resample_mean(
        studies.shed_intervals(base, scen, link(spark)), ["oat_f", "base_kw", "scenario_kw", "shed_pct", "shed_w_ft2"]
    )
    def rounded(df):
        return rows(df.select("run_id", "ts", *(F.round(c, 9) for c in df.columns[2:])))
    fast = rounded(studies.shed_hourly(base, scen, link(spark)))
    assert fast == rounded(slow) and len(fast) == 120


def test_hourly_study_moves_the_scenario_once_and_copies_no_interval(spark, tmp_path):
    for name, kw in (("b", 100), ("s", 90)):
        series(spark, name, lambda d, h, q: kw + h).write.parquet(str(tmp_path / name))
    link(spark).write.parquet(str(tmp_path / "link"))
    base, scen, links = (spark.read.parquet(str(tmp_path / n)) for n in ("b", "s", "link"))
    plan = studies.shed_hourly(base, scen, links)
    text = plan._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_spread" in line for line in exchanges) <= 2  # the baseline's means and the link, no interval
    assert sum("run_id" in line and "hashpartitioning(baseline_id" in line and "bin" not in line for line in exchanges) == 0
