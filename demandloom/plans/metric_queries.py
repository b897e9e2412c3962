"""Queries over interval series."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.constants import OUTPUT_SPEC
from demandloom.functions.calendar import is_workday_in, minute_stamp, with_calendar
from demandloom.operators import collection, metrics, quantiles
from demandloom.plans import inputs, studies
from demandloom.plans.registry import query
from demandloom.session import scratch_dir
from demandloom.sources import stored_pairs


def stamp(name: str = "ts"):
    return minute_stamp(F.col(name)).alias(name)


def r6(name: str):
    return F.round(name, 6).alias(name)


def hourly(spark, sf_dir):
    base, scen = inputs.baseline_and_scenarios(spark, sf_dir)
    return studies.shed_hourly(base, scen, inputs.link(spark), inputs.MONTHS)


def cells(spark, sf_dir):
    return metrics.day_hour_cells(hourly(spark, sf_dir))


@query(
    "shed_profile_by_hour",
    f"WITH {inputs.CELLS_SQL} SELECT run_id, hour, round(avg(v), 6) AS mean_shed_w_ft2, "
    "count(v) AS n_days FROM cells GROUP BY 1, 2",
)
def shed_profile_by_hour(spark, sf_dir):
    profile = metrics.mean_profile(cells(spark, sf_dir))
    return profile.select("run_id", "hour", r6("mean_shed_w_ft2"), "n_days")


@query(
    "meter_units",
    f"WITH {inputs.RAW_METER_SQL} SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, "
    "round(oat_f, 6) AS oat_f, round(bldg_kw, 6) AS bldg_kw FROM meter",
)
def meter_units(spark, sf_dir):
    return inputs.meter(spark, sf_dir).select("run_id", stamp(), r6("oat_f"), r6("bldg_kw"))


SHED_INTERVALS_SQL = (
    f"WITH {inputs.HOURLY_SQL} SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, "
    "round(base_kw, 6) AS base_kw, round(scenario_kw, 6) AS scenario_kw, "
    "round(shed_pct, 6) AS shed_pct, round(shed_w_ft2, 6) AS shed_w_ft2 FROM shed"
)


def interval_columns(shed):
    return shed.select("run_id", stamp(), r6("base_kw"), r6("scenario_kw"), r6("shed_pct"), r6("shed_w_ft2"))


@query("shed_intervals", SHED_INTERVALS_SQL)
def shed_intervals(spark, sf_dir):
    base, scen = inputs.baseline_and_scenarios(spark, sf_dir)
    return interval_columns(studies.shed_intervals(base, scen, inputs.link(spark), inputs.MONTHS))


@query("shed_intervals_stored", SHED_INTERVALS_SQL)
def shed_intervals_stored(spark, sf_dir):
    base, scen = inputs.baseline_and_scenarios(spark, sf_dir)
    pairs = stored_pairs.write_pairs(base, scen, inputs.link(spark), scratch_dir(spark, "pairs"))
    return interval_columns(studies.shed_intervals_stored(spark, pairs, inputs.MONTHS))


@query(
    "shed_hourly",
    f"WITH {inputs.HOURLY_SQL} SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, "
    "round(oat_f, 6) AS oat_f, round(shed_pct, 6) AS shed_pct, "
    "round(shed_w_ft2, 6) AS shed_w_ft2 FROM hourly",
)
def shed_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).select("run_id", stamp(), r6("oat_f"), r6("shed_pct"), r6("shed_w_ft2"))


FIT_SQL = inputs.HOURLY_SQL + """,
seg AS (
  SELECT run_id, CAST(hour(ts) AS INTEGER) AS hour,
         CASE WHEN oat_f <= 75 THEN 'low' ELSE 'high' END AS segment, oat_f AS x, shed_w_ft2 AS y
  FROM hourly WHERE shed_w_ft2 IS NOT NULL AND oat_f IS NOT NULL),
fit AS (
  SELECT run_id, hour, segment, count(y) AS n,
         CASE WHEN count(y) > 1 THEN regr_slope(y, x) END AS slope,
         CASE WHEN count(y) > 1 THEN regr_intercept(y, x) END AS intercept,
         CASE WHEN count(y) > 1 THEN regr_r2(y, x) END AS r2,
         min(x) AS x_min, max(x) AS x_max
  FROM seg GROUP BY 1, 2, 3)"""


@query(
    "shed_piecewise_fit",
    f"WITH {FIT_SQL} SELECT run_id, hour, hour + 1 AS panel_hour, segment, n, "
    "round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, "
    "round(x_min, 6) AS x_min, round(x_max, 6) AS x_max FROM fit",
)
def shed_piecewise_fit(spark, sf_dir):
    base, scen = inputs.baseline_and_scenarios(spark, sf_dir)
    return studies.shed_fit_study(base, scen, inputs.link(spark), inputs.MONTHS).select(
        "run_id", "hour", "panel_hour", "segment", "n", r6("slope"),
        F.round("intercept", 4).alias("intercept"), r6("r2"), r6("x_min"), r6("x_max"),
    )


@query(
    "shed_fit_line",
    f"WITH {FIT_SQL} SELECT run_id, hour, segment, CAST(i AS INTEGER) AS sample_no, "
    "round(lo + (hi - lo) * i / 99.0e0, 6) AS x, "
    "round(slope * (lo + (hi - lo) * i / 99.0e0) + intercept, 4) AS y "
    "FROM (SELECT *, CASE segment WHEN 'low' THEN x_min ELSE 75e0 END AS lo, "
    "CASE segment WHEN 'low' THEN 75e0 ELSE x_max END AS hi FROM fit WHERE slope IS NOT NULL) f, "
    "range(100) t(i)",
)
def shed_fit_line(spark, sf_dir):
    line = metrics.fit_line(metrics.piecewise_fit(hourly(spark, sf_dir)))
    return line.select("run_id", "hour", "segment", "sample_no", r6("x"), F.round("y", 4).alias("y"))


BOX_SQL = inputs.CELLS_SQL + """,
q AS (
  SELECT run_id, hour, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
         quantile_cont(v, 0.75) AS q3, count(v) AS n_days, avg(v) AS mean
  FROM cells GROUP BY 1, 2),
marked AS (
  SELECT c.run_id, c.hour, c.day, c.v, q1, median, q3, n_days, mean,
         c.v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS inside
  FROM cells c JOIN q ON q.run_id = c.run_id AND q.hour = c.hour)"""


@query(
    "shed_box_stats",
    f"WITH {BOX_SQL} SELECT run_id, hour, any_value(n_days) AS n_days, "
    "round(any_value(mean), 6) AS mean, round(any_value(q1), 6) AS q1, "
    "round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, "
    "round(least(min(v) FILTER (inside), any_value(q1)), 6) AS whisker_low, "
    "round(greatest(max(v) FILTER (inside), any_value(q3)), 6) AS whisker_high, "
    "count(*) FILTER (NOT inside) AS n_outliers FROM marked GROUP BY 1, 2",
)
def shed_box_stats(spark, sf_dir):
    base, scen = inputs.baseline_and_scenarios(spark, sf_dir)
    box = studies.shed_box_study(base, scen, inputs.link(spark), inputs.MONTHS)
    return box.select(
        "run_id", "hour", "n_days", r6("mean"), r6("q1"), r6("median"), r6("q3"),
        r6("whisker_low"), r6("whisker_high"), "n_outliers",
    )


def fleet_box_sql(values: str) -> str:
    return f"""{values},
q AS (SELECT hour, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM vals GROUP BY 1),
marked AS (SELECT v, q.*, v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS inside FROM vals JOIN q USING (hour))
SELECT hour, count(*) AS n, round(avg(v), 6) AS mean, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3, round(least(min(v) FILTER (inside), any_value(q1)), 6) AS whisker_low,
  round(greatest(max(v) FILTER (inside), any_value(q3)), 6) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM marked GROUP BY hour"""


def rounded_boxes(boxes):
    return boxes.select(
        "hour", "n", r6("mean"), r6("q1"), r6("median"), r6("q3"), r6("whisker_low"), r6("whisker_high"), "n_outliers"
    )


@query("fleet_box_stats", fleet_box_sql(f"WITH {inputs.CELLS_SQL}, vals AS (SELECT hour, v FROM cells)"))
def fleet_box_stats(spark, sf_dir):
    """The scenarios of all runs in one box per hour of the day."""
    return rounded_boxes(quantiles.fleet_box_stats(cells(spark, sf_dir), "shed_w_ft2"))


@query(
    "event_box_stats",
    fleet_box_sql("WITH vals AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, value AS v FROM events WHERE value IS NOT NULL)"),
)
def event_box_stats(spark, sf_dir):
    """Raw readings, one box per hour of the day."""
    readings = inputs.table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "value")
    return rounded_boxes(quantiles.fleet_box_stats(readings, "value"))


@query(
    "shed_box_outliers",
    f"WITH {BOX_SQL} SELECT run_id, day, hour, round(v, 6) AS shed_w_ft2 FROM marked WHERE NOT inside",
)
def shed_box_outliers(spark, sf_dir):
    return metrics.box_outliers(cells(spark, sf_dir)).select("run_id", "day", "hour", r6("shed_w_ft2"))


@query(
    "shed_day_hour_pivot",
    f"WITH {inputs.CELLS_SQL} SELECT run_id, day, "
    + ", ".join(f"round(max(v) FILTER (hour = {h}), 6) AS h{h:02d}" for h in range(24))
    + " FROM cells GROUP BY 1, 2",
)
def shed_day_hour_pivot(spark, sf_dir):
    wide = metrics.day_hour_pivot(hourly(spark, sf_dir))
    return wide.select("run_id", "day", *(r6(f"h{h:02d}") for h in range(24)))


@query(
    "shed_day_of_month_cells",
    f"WITH {inputs.HOURLY_SQL} SELECT run_id, strftime(ts, '%Y-%d') AS day, "
    "CAST(hour(ts) AS INTEGER) AS hour, round(avg(shed_w_ft2), 6) AS shed_w_ft2 "
    "FROM hourly WHERE shed_w_ft2 IS NOT NULL GROUP BY 1, 2, 3",
)
def shed_day_of_month_cells(spark, sf_dir):
    out = metrics.day_hour_cells(hourly(spark, sf_dir), day="year_dom")
    return out.select("run_id", "day", "hour", r6("shed_w_ft2"))


@query(
    "shed_peak",
    f"WITH {inputs.HOURLY_SQL} SELECT run_id, round(max(shed_w_ft2), 6) AS peak_shed_w_ft2 "
    "FROM shed GROUP BY 1",
)
def shed_peak(spark, sf_dir):
    base, scen = inputs.baseline_and_scenarios(spark, sf_dir)
    shed = studies.shed_intervals(base, scen, inputs.link(spark), inputs.MONTHS)
    return metrics.peak_shed(shed).select("run_id", r6("peak_shed_w_ft2"))


@query(
    "hourly_resample_dense",
    f"""WITH {inputs.RAW_METER_SQL},
wk AS (SELECT * FROM meter WHERE dayofweek(ts) BETWEEN 1 AND 5 AND month(ts) = 1),
h AS (SELECT run_id, time_bucket(INTERVAL '1 hour', ts) AS ts, avg(bldg_kw) AS bldg_kw
      FROM wk GROUP BY 1, 2),
span AS (SELECT run_id, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts
         FROM h GROUP BY 1)
SELECT s.run_id, strftime(s.ts, '%Y-%m-%d %H:%M') AS ts, round(h.bldg_kw, 6) AS bldg_kw
FROM span s LEFT JOIN h ON h.run_id = s.run_id AND h.ts = s.ts""",
)
def hourly_resample_dense(spark, sf_dir):
    workdays = inputs.meter(spark, sf_dir).where(is_workday_in(F.col("ts"), inputs.MONTHS))
    out = metrics.resample_mean(workdays, ["bldg_kw"], densify=True)
    return out.select("run_id", stamp(), r6("bldg_kw"))


@query(
    "calendar_features",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%H:%M') AS time,
CAST(month(o_orderdate) AS INTEGER) AS month, strftime(o_orderdate, '%d') AS day,
CAST(hour(o_orderdate) AS INTEGER) AS hour, strftime(o_orderdate, '%M') AS minute,
CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday FROM orders""",
)
def calendar_features(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return with_calendar(orders, "o_orderdate").drop("o_orderdate")


@query(
    "summer_workdays",
    """SELECT CAST(month(l_shipdate) AS INTEGER) AS month, CAST(dayofweek(l_shipdate) AS INTEGER) AS weekday,
count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5 AND month(l_shipdate) BETWEEN 5 AND 10 GROUP BY 1, 2""",
)
def summer_workdays(spark, sf_dir):
    items = inputs.table(spark, sf_dir, "lineitem").where(is_workday_in(F.col("l_shipdate")))
    return items.groupBy(
        F.month("l_shipdate").alias("month"), (F.dayofweek("l_shipdate") - 1).alias("weekday")
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# Long report rows from the events: each event type is a reported variable.
REPORT_SPEC = {
    "oat_c": ("Environment", "view", "Zone Timestep"),
    "elec_j": (None, "purchase", "Zone Timestep"),
}


def report(spark, sf_dir, run=None):
    from demandloom.functions.calendar import weekday

    return inputs.table(spark, sf_dir, "events").select(
        (F.col("user_id").cast("string") if run is None else run).alias("run_id"),
        (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("long").alias("step_no"),
        F.when(F.get_json_object("props", "$.k").cast("int") < 90, "Environment")
        .otherwise("Zone").alias("key_value"),
        F.col("event_type").alias("name"),
        F.when(weekday(F.col("ts")) > 0, "Zone Timestep").otherwise("Hourly").alias("reporting_frequency"),
        "value",
    )


@query(
    "report_to_wide",
    """WITH r AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, day(ts) * 24 + hour(ts) AS step_no, event_type AS name, value,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) < 90 AS env
  FROM events WHERE dayofweek(ts) > 0)
SELECT run_id, step_no, max(value) FILTER (name = 'view' AND env) AS oat_c,
       max(value) FILTER (name = 'purchase') AS elec_j
FROM r WHERE (name = 'view' AND env) OR name = 'purchase' GROUP BY 1, 2""",
)
def report_to_wide(spark, sf_dir):
    return collection.report_to_wide(report(spark, sf_dir), REPORT_SPEC)


assert set(REPORT_SPEC) == set(OUTPUT_SPEC)
