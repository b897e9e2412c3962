"""The shared test tables in the shapes the operators expect.

The tables hold no buildings, so columns stand in for them (README, "Stand-ins").
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.operators import metrics
from demandloom.session import fixed_table

# Baseline run, the scenarios compared with it, and the floor area used for all.
BASELINE_RUN = "view"
SCENARIO_RUNS = ("click", "error", "purchase", "signup")
FLOOR_AREA = 500.0
MONTHS = (1,)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute series per event type: energy from ``value``, temperature from ``props.k``."""
    degree = F.get_json_object("props", "$.k").cast("double")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run_id"), F.window("ts", "15 minutes").alias("w"))
        .agg((F.sum("value") * 1e6).alias("elec_j"), (F.avg(degree) / 2).alias("oat_c"))
        .select("run_id", F.col("w.start").alias("ts"), "elec_j", "oat_c")
    )


RAW_METER_SQL = """
raw_meter AS (
  SELECT event_type AS run_id, time_bucket(INTERVAL '15 minutes', ts) AS ts,
         sum(value) * 1e6 AS elec_j,
         avg(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE)) / 2 AS oat_c
  FROM events GROUP BY 1, 2),
meter AS (
  SELECT run_id, ts, oat_c * 1.8e0 + 32 AS oat_f, elec_j / 900000e0 AS bldg_kw FROM raw_meter)"""


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.to_meter(raw_meter(spark, sf_dir))


def link(spark: SparkSession) -> DataFrame:
    rows = [(run, BASELINE_RUN, FLOOR_AREA) for run in SCENARIO_RUNS]
    return fixed_table(spark, rows, "run_id string, baseline_id string, floor_area double")


def baseline_and_scenarios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = meter(spark, sf_dir)
    return runs.where(F.col("run_id") == BASELINE_RUN), runs.where(F.col("run_id").isin(*SCENARIO_RUNS))


WORKDAY_SQL = "dayofweek({ts}) BETWEEN 1 AND 5 AND month({ts}) IN (1)"

HOURLY_SQL = RAW_METER_SQL + """,
wk AS (SELECT * FROM meter WHERE dayofweek(ts) BETWEEN 1 AND 5 AND month(ts) = 1),
link AS (SELECT unnest(['click', 'error', 'purchase', 'signup']) AS run_id),
shed AS (
  SELECT l.run_id, b.ts, b.oat_f, b.bldg_kw AS base_kw, s.bldg_kw AS scenario_kw,
         (b.bldg_kw - s.bldg_kw) / nullif(b.bldg_kw, 0) AS shed_pct,
         (b.bldg_kw - s.bldg_kw) * 1000 / 500e0 AS shed_w_ft2
  FROM wk b CROSS JOIN link l
  LEFT JOIN wk s ON s.run_id = l.run_id AND s.ts = b.ts
  WHERE b.run_id = 'view'),
hourly AS (
  SELECT run_id, time_bucket(INTERVAL '1 hour', ts) AS ts, avg(oat_f) AS oat_f,
         avg(base_kw) AS base_kw, avg(scenario_kw) AS scenario_kw,
         avg(shed_pct) AS shed_pct, avg(shed_w_ft2) AS shed_w_ft2
  FROM shed GROUP BY 1, 2)"""

# Mean per run, day and hour of the hourly shed density.
CELLS_SQL = HOURLY_SQL + """,
cells AS (
  SELECT run_id, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS INTEGER) AS hour,
         avg(shed_w_ft2) AS v
  FROM hourly WHERE shed_w_ft2 IS NOT NULL GROUP BY 1, 2, 3)"""

# One breakpoint per order and line number, the last one moved to midnight.
PROFILE_SQL = """
pts AS (
  SELECT l_orderkey AS profile_id, l_linenumber * 180 AS until_min, max(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2),
prof AS (
  SELECT profile_id,
         CAST(CASE WHEN until_min = max(until_min) OVER (PARTITION BY profile_id) THEN 1440
              ELSE until_min END AS INTEGER) AS until_min, value
  FROM pts)"""
