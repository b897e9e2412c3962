"""Queries over designs, grids and workflow documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom import constants as K
from demandloom.functions.calendar import minute_stamp
from demandloom.operators import design, workflow
from demandloom.plans import inputs
from demandloom.plans.registry import query
from demandloom.session import fixed_table, scratch_dir
from demandloom.sources import readers, writers


def text(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def base_models(spark, sf_dir):
    nation = F.col("s_nationkey").cast("string")
    return inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("BaseModelId"),
        text("Type", nation).alias("bldg_type"),
        text("DOE Ref ", nation).alias("bldg_vintage"),
        text("ASHRAE 169-2006-", nation).alias("climate_zone"),
        F.lit("4").alias("time_step"),
    )


def events(spark, sf_dir):
    k = F.col("n_nationkey")
    start = k % 8 + 8
    return inputs.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("MeasureId"),
        k.alias("event_pos"),
        start.cast("string").alias("start_hour"),
        (start + 2 + k % 3).cast("string").alias("end_hour"),
        (k % 4).cast("string").alias("precool_hours"),
        (k % 5).cast("string").alias("precool_deg"),
        (k % 6).cast("string").alias("reset_deg"),
    )


CASES_SQL = """
ev AS (SELECT n_name AS event, n_nationkey AS k, n_nationkey % 8 + 8 AS start,
              n_nationkey % 8 + 10 + n_nationkey % 3 AS stop FROM nation),
cases AS (SELECT s_name || '_' || event AS case_id, s.*, e.*
          FROM supplier s CROSS JOIN ev e)"""

PROTO_ARGS_SQL = """
(0, 'CreateDOEPrototypeBuilding', 'building_type', 'Type' || s_nationkey),
(0, 'CreateDOEPrototypeBuilding', 'template', 'DOE Ref ' || s_nationkey),
(0, 'CreateDOEPrototypeBuilding', 'climate_zone', 'ASHRAE 169-2006-' || s_nationkey),
(1, 'SetTimestep', 'timestep', '4')"""


@query(
    "case_steps",
    f"""WITH {CASES_SQL}
SELECT case_id, CAST(pos AS INTEGER) AS step_pos, measure, argument, value FROM cases, LATERAL (VALUES
{PROTO_ARGS_SQL},
(2, 'ChangeHeatingAndCoolingSetpoint', 'cooling_adjustment', CAST(-(k % 5) AS VARCHAR)),
(2, 'ChangeHeatingAndCoolingSetpoint', 'heating_adjustment', '0'),
(2, 'ChangeHeatingAndCoolingSetpoint', 'start_hour', CAST(start - k % 4 AS VARCHAR)),
(2, 'ChangeHeatingAndCoolingSetpoint', 'end_hour', CAST(start AS VARCHAR)),
(3, 'ChangeHeatingAndCoolingSetpoint', 'cooling_adjustment', CAST(k % 6 AS VARCHAR)),
(3, 'ChangeHeatingAndCoolingSetpoint', 'heating_adjustment', '0'),
(3, 'ChangeHeatingAndCoolingSetpoint', 'start_hour', CAST(start AS VARCHAR)),
(3, 'ChangeHeatingAndCoolingSetpoint', 'end_hour', CAST(stop AS VARCHAR))
) v(pos, measure, argument, value)""",
)
def case_steps(spark, sf_dir):
    cases = workflow.event_cases(base_models(spark, sf_dir), events(spark, sf_dir))
    return workflow.explode_steps(cases)


@query(
    "case_steps_running",
    f"""WITH {CASES_SQL}
SELECT case_id, 2 + 2 * CAST(row_number() OVER w AS INTEGER) AS n_steps,
       1 + 2 * CAST(row_number() OVER w AS INTEGER) AS last_step_pos
FROM cases WINDOW w AS (PARTITION BY s_name ORDER BY k)""",
)
def case_steps_running(spark, sf_dir):
    cases = workflow.event_cases(base_models(spark, sf_dir), events(spark, sf_dir))
    return workflow.running_event_steps(cases).select("case_id", "n_steps", "last_step_pos")


def uneven_cases(spark, sf_dir):
    """Cases without a pre-cool step where there is nothing to pre-cool."""
    cases = workflow.event_cases(base_models(spark, sf_dir), events(spark, sf_dir))
    cooled = F.col("precool_hours") != "0"
    short = F.array(F.col("steps")[0], F.col("steps")[1], F.col("steps")[3])
    return cases.withColumn("steps", F.when(cooled, F.col("steps")).otherwise(short))


@query(
    "case_steps_running_uneven",
    f"""WITH {CASES_SQL}
SELECT case_id, CAST(2 + n AS INTEGER) AS n_steps, CAST(1 + n AS INTEGER) AS last_step_pos
FROM (SELECT case_id, sum(1 + CAST(k % 4 > 0 AS INTEGER)) OVER (PARTITION BY s_name ORDER BY k) AS n FROM cases)""",
)
def case_steps_running_uneven(spark, sf_dir):
    counted = workflow.running_event_steps(uneven_cases(spark, sf_dir), block_events=4)
    return counted.select("case_id", "n_steps", "last_step_pos")


@query(
    "case_steps_piled",
    f"""WITH {CASES_SQL},
own AS (SELECT s_name, k, case_id AS from_case, n, CAST(CASE n WHEN 0 THEN -(k % 5) ELSE k % 6 END AS VARCHAR) AS adjustment
  FROM cases, range(2) t(n) WHERE n = 1 OR k % 4 > 0),
pile AS (SELECT *, 1 + row_number() OVER (PARTITION BY s_name ORDER BY k, n) AS step_pos FROM own)
SELECT case_id, CAST(step_pos AS INTEGER) AS step_pos, from_case, 'ChangeHeatingAndCoolingSetpoint' AS measure, adjustment
FROM cases c JOIN pile p ON p.s_name = c.s_name AND p.k <= c.k
UNION ALL SELECT case_id, 0, case_id, 'CreateDOEPrototypeBuilding', NULL FROM cases
UNION ALL SELECT case_id, 1, case_id, 'SetTimestep', NULL FROM cases""",
)
def case_steps_piled(spark, sf_dir):
    piled = workflow.piled_up_steps(uneven_cases(spark, sf_dir), block_events=4)
    adjustment = F.col("step.arguments.cooling_adjustment").cast("string")
    return piled.select("case_id", "step_pos", "from_case", F.col("step.measure_dir_name").alias("measure"), adjustment.alias("adjustment"))


@query(
    "workflow_documents",
    """SELECT s_name AS case_id,
'{"file_paths":["."],"measure_paths":["measures"],"seed_file":null,"weather_file":"site.epw","run_directory":"run/'
|| s_name || '","steps":[{"measure_dir_name":"CreateDOEPrototypeBuilding","arguments":{"building_type":"Type'
|| s_nationkey || '","template":"DOE Ref ' || s_nationkey || '","climate_zone":"ASHRAE 169-2006-' || s_nationkey
|| '"}},{"measure_dir_name":"SetTimestep","arguments":{"timestep":"4"}}]}' AS document FROM supplier""",
)
def workflow_documents(spark, sf_dir):
    cases = base_models(spark, sf_dir).withColumns(
        {
            "case_id": F.col("BaseModelId"),
            "steps": F.array(workflow.prototype_step(), workflow.timestep_step()),
        }
    )
    return workflow.documents(cases, ["."], ["measures"], None, "site.epw")


def grid_models(spark, sf_dir):
    return (
        inputs.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
        .select(text("model_", F.col("s_nationkey").cast("string")).alias("model_id"))
    )


def listed(values):
    return "unnest([" + ", ".join(str(v) for v in values) + "])"


@query(
    "event_grid",
    f"""SELECT model_id, CAST(t AS INTEGER) AS hvac_tstat, CAST(s AS INTEGER) AS event_start,
CAST(h AS INTEGER) AS event_hours, CAST(ph AS INTEGER) AS precool_hours,
CAST(pd AS INTEGER) AS precool_deg, CAST(r AS INTEGER) AS reset_deg,
'DF_' || t || '_' || s || '_' || h || '_' || ph || '_' || pd || '_' || r AS case_id
FROM (SELECT DISTINCT 'model_' || s_nationkey AS model_id FROM supplier) m,
(SELECT {listed(range(70, 77))} AS t), (SELECT {listed(range(6, 22))} AS s),
(SELECT {listed([2, 4, 6])} AS h), (SELECT {listed([2, 4, 6])} AS ph),
(SELECT {listed([0, 2, 4])} AS pd), (SELECT {listed([0, 2, 4, 6])} AS r)
WHERE s + h <= 22 AND t - pd >= 70 AND t + r <= 80""",
)
def event_grid(spark, sf_dir):
    return design.event_grid(grid_models(spark, sf_dir))


@query(
    "event_grid_repeated_ids",
    f"""SELECT model_id, count(*) AS n_cases, count(DISTINCT (t, s, h, pd, r)) AS n_ids
FROM (SELECT DISTINCT 'model_' || s_nationkey AS model_id FROM supplier) m,
(SELECT {listed(range(70, 77))} AS t), (SELECT {listed(range(6, 22))} AS s),
(SELECT {listed([2, 4, 6])} AS h), (SELECT {listed([2, 4, 6])} AS ph),
(SELECT {listed([0, 2, 4])} AS pd), (SELECT {listed([0, 2, 4, 6])} AS r)
WHERE s + h <= 22 AND t - pd >= 70 AND t + r <= 80 GROUP BY 1""",
)
def event_grid_repeated_ids(spark, sf_dir):
    grid = design.event_grid(grid_models(spark, sf_dir), compat=True)
    return grid.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_distinct("case_id").alias("n_ids")
    )


@query(
    "model_grid",
    """SELECT 'model_' || a || '_' || b || '_' || c AS model_id, a AS bldg_type, b AS bldg_vintage, c AS climate
FROM (SELECT DISTINCT c_mktsegment AS a FROM customer),
(SELECT DISTINCT o_orderpriority AS b FROM orders), (SELECT DISTINCT l_returnflag || l_linestatus AS c FROM lineitem)""",
)
def model_grid(spark, sf_dir):
    types = inputs.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("bldg_type"))
    vintages = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("bldg_vintage"))
    climates = inputs.table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("climate")
    )
    return design.model_grid(types.distinct(), vintages.distinct(), climates.distinct())


def case_of(column, values):
    pairs = " ".join(f"WHEN '{v}' THEN {c}" for v, c in values.items())
    return f"CASE CAST({column} AS VARCHAR) {pairs} END"


GRID_COLUMNS_SQL = """
g AS (SELECT o_orderkey, ['SmallOffice','MediumOffice','LargeOffice','SmallRetail','Hotel'][o_orderkey % 5 + 1] AS bldg_type,
  CAST(68 + o_orderkey % 10 AS INTEGER) AS hvac_tstat, CAST(o_custkey % 24 AS INTEGER) AS event_start,
  CAST(o_orderkey % 8 AS INTEGER) AS event_hours, CAST(o_custkey % 7 AS INTEGER) AS precool_hours,
  CAST(o_orderkey % 5 AS INTEGER) AS precool_deg, CAST(o_custkey % 9 AS INTEGER) AS reset_deg FROM orders)"""

CODED = ["bldg_type", "hvac_tstat", "event_start", "event_hours", "precool_hours", "precool_deg", "reset_deg"]


@query(
    "grid_codes",
    f"WITH {GRID_COLUMNS_SQL} SELECT o_orderkey, "
    + ", ".join(f"coalesce({case_of(c, K.CODES[c])}, -1) AS {c}_code" for c in CODED)
    + " FROM g",
)
def grid_codes(spark, sf_dir):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*(F.lit(v) for v in ["SmallOffice", "MediumOffice", "LargeOffice", "SmallRetail", "Hotel"]))
    grid = inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.get(names, (order % 5).cast("int")).alias("bldg_type"),
        (order % 10 + 68).cast("int").alias("hvac_tstat"),
        (customer % 24).cast("int").alias("event_start"),
        (order % 8).cast("int").alias("event_hours"),
        (customer % 7).cast("int").alias("precool_hours"),
        (order % 5).cast("int").alias("precool_deg"),
        (customer % 9).cast("int").alias("reset_deg"),
    )
    coded = design.encode(grid)
    return coded.select("o_orderkey", *(F.coalesce(f"{c}_code", F.lit(-1)).alias(f"{c}_code") for c in CODED))


@query(
    "baseline_match",
    """WITH c AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS case_id, l_suppkey AS model_id,
         70 + l_linenumber AS hvac_tstat, month(l_shipdate) + 6 AS event_start, l_linestatus AS event_hours,
         CAST(round(l_discount * 100) AS INTEGER) % 3 AS precool_deg,
         CAST(round(l_tax * 100) AS INTEGER) % 3 AS reset_deg FROM lineitem),
b AS (SELECT model_id, hvac_tstat, event_start, event_hours, min(case_id) AS baseline_id FROM c
      WHERE precool_deg = 0 AND reset_deg = 0 GROUP BY 1, 2, 3, 4)
SELECT case_id, precool_deg, reset_deg, coalesce(baseline_id, 'none') AS baseline_id
FROM c LEFT JOIN b USING (model_id, hvac_tstat, event_start, event_hours)""",
)
def baseline_match(spark, sf_dir):
    cases = inputs.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("case_id"),
        F.col("l_suppkey").alias("model_id"),
        (F.col("l_linenumber") + 70).alias("hvac_tstat"),
        (F.month("l_shipdate") + 6).alias("event_start"),
        F.col("l_linestatus").alias("event_hours"),
        (F.col("l_linenumber") % 3).alias("precool_hours"),
        (F.round(F.col("l_discount") * 100).cast("int") % 3).alias("precool_deg"),
        (F.round(F.col("l_tax") * 100).cast("int") % 3).alias("reset_deg"),
    )
    matched = design.match_baseline(cases)
    return matched.select(
        "case_id", "precool_deg", "reset_deg", F.coalesce("baseline_id", F.lit("none")).alias("baseline_id")
    )


# Measure and argument of each design column; ``p_type`` has none and is reported.
LOOKUP = [
    ("p_brand", "prototype", "building_type"),
    ("p_size", "wall_r", "r_value"),
    ("p_retailprice", "timestep", "price"),
]
LOOKUP_SQL = "lookup(param, measure, argument) AS (VALUES " + ", ".join(str(r) for r in LOOKUP) + ")"
LONG_SQL = """
long AS (SELECT p_partkey AS case_no, pos AS param_pos, param, value FROM part, LATERAL (VALUES
  (0, 'p_brand', p_brand), (1, 'p_type', p_type), (2, 'p_size', CAST(p_size AS VARCHAR))) v(pos, param, value))"""


def part_design(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part")
    return design.design_long(
        parts.select(F.col("p_partkey").alias("case_no"), "p_brand", "p_type", "p_size")
    )


def lookup(spark):
    return fixed_table(spark, LOOKUP, "param string, measure string, argument string")


@query(
    "design_lookup",
    f"WITH {LOOKUP_SQL}, {LONG_SQL} SELECT case_no, CAST(param_pos AS INTEGER) AS param_pos, param, value, measure, argument, "
    "CASE WHEN measure IS NULL THEN 'no description for ' || param END AS error FROM long LEFT JOIN lookup USING (param)",
)
def design_lookup(spark, sf_dir):
    return design.join_lookup(part_design(spark, sf_dir), lookup(spark))


@query(
    "design_missing",
    f"WITH {LOOKUP_SQL}, {LONG_SQL} SELECT param, count(*) AS n_cases FROM long "
    "WHERE param NOT IN (SELECT param FROM lookup) GROUP BY 1",
)
def design_missing(spark, sf_dir):
    return design.missing_params(part_design(spark, sf_dir), lookup(spark))


@query(
    "design_steps",
    """WITH a(pos, measure, argument, p) AS (VALUES (0, 'CreateDOEPrototypeBuilding', 'building_type', 0), (0, 'CreateDOEPrototypeBuilding', 'template', 1),
(0, 'CreateDOEPrototypeBuilding', 'climate_zone', 2), (1, 'IncreaseWallRValue', 'r_value', 3), (2, 'AddOutputVariable', 'variable_name', 4),
(2, 'AddOutputVariable', 'reporting_frequency', 5))
SELECT 'part_Inst_' || p_partkey AS run, 'no description for p_type' AS errors, pos AS step_pos, measure, argument,
[p_brand, 'building_type', 'p_brand', CAST(p_size AS VARCHAR), 'Site Outdoor Air Drybulb Temperature', 'timestep'][p + 1] AS value FROM part, a""",
)
def design_steps(spark, sf_dir):
    from demandloom.functions.naming import instance_name

    builders = {
        "prototype": workflow.STEP_KINDS["prototype"]("value", "argument", "param"),
        "wall_r": workflow.STEP_KINDS["wall_r"]("value"),
    }
    described = design.join_lookup(part_design(spark, sf_dir), lookup(spark))
    built = workflow.dispatch_steps(described, builders).withColumn("pos", F.col("param_pos"))
    outdoor = inputs.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("case_no"), F.lit(0).alias("pos"),
        F.lit(K.OUTDOOR_TEMPERATURE).alias("variable_name"), F.lit("timestep").alias("reporting_frequency"),
    ).withColumn("step", workflow.STEP_KINDS["output_variable"]())
    parts = [built.where(F.col("step").isNotNull()), outdoor]
    cases = workflow.assemble_steps(workflow.append_steps(parts, ["case_no"]), ["case_no"])
    errors = built.groupBy("case_no").agg(F.array_join(F.sort_array(F.collect_list("error")), "; ").alias("errors"))
    named = cases.join(errors, "case_no", "left").withColumn("run", instance_name(F.lit("part"), F.col("case_no")))
    return workflow.explode_steps(named, ["run", "errors"])


@query(
    "seed_ids",
    """SELECT 'list' || s_suppkey % 10 AS file, s_suppkey // 10 AS model_no, s_name || '-' || (s_nationkey + 1980) || '-' || s_nationkey || 'B' AS seed_id,
CAST(2 AS BIGINT) AS n_steps FROM supplier""",
)
def seed_ids(spark, sf_dir):
    models = inputs.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("list"), (F.col("s_suppkey") % 10).cast("string")).alias("file"),
        F.floor(F.col("s_suppkey") / 10).alias("model_no"),
        F.col("s_name").alias("bldg_type"),
        text("DOE Ref ", (F.col("s_nationkey") + 1980).cast("string")).alias("bldg_vintage"),
        text("ASHRAE 169-2006-", F.col("s_nationkey").cast("string"), "B").alias("climate_zone"),
        F.col("s_acctbal").alias("WallRValue"),
    )
    steps = models.select(
        "file", "model_no",
        F.posexplode(F.array(workflow.prototype_step(), workflow.wall_r_step())).alias("step_pos", "step"),
    )
    return workflow.seed_models(steps)


@query(
    "output_request_steps",
    """SELECT p_partkey, measure, argument, value FROM part, LATERAL (VALUES
(CASE WHEN p_size % 2 = 0 THEN 'AddOutputMeter' ELSE 'AddOutputVariable' END,
 CASE WHEN p_size % 2 = 0 THEN 'meter_name' ELSE 'variable_name' END, p_name),
(CASE WHEN p_size % 2 = 0 THEN 'AddOutputMeter' ELSE 'AddOutputVariable' END,
 'reporting_frequency', lower(p_type))) v(measure, argument, value)""",
)
def output_request_steps(spark, sf_dir):
    requests = inputs.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 2 == 0, "meter").otherwise("variable").alias("report"),
        F.col("p_name").alias("variable_name"),
        F.lower("p_type").alias("reporting_frequency"),
    )
    steps = requests.withColumn("steps", F.array(workflow.output_step()))
    return workflow.explode_steps(steps, ["p_partkey"]).drop("step_pos")


@query(
    "case_counts",
    f"""WITH {CASES_SQL} SELECT s_nationkey, count(*) AS n_cases FROM cases GROUP BY 1""",
)
def case_counts(spark, sf_dir):
    cases = workflow.event_cases(base_models(spark, sf_dir), events(spark, sf_dir))
    nation = F.substring("bldg_type", 5, 10).cast("int").alias("s_nationkey")
    return cases.groupBy(nation).agg(F.count(F.lit(1)).alias("n_cases"))


@query(
    "wide_files_round_trip",
    f"WITH {inputs.RAW_METER_SQL} SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, "
    "round(oat_c, 6) AS oat_c, round(elec_j, 2) AS elec_j FROM raw_meter",
)
def wide_files_round_trip(spark, sf_dir):
    path = scratch_dir(spark, "wide")
    wide = writers.with_published_headers(inputs.raw_meter(spark, sf_dir))
    writers.write_wide(wide, path, order="ts")
    back = readers.read_runs(spark, path, layout="buckets")
    return back.select(
        "run_id", minute_stamp(F.col("ts")).alias("ts"),
        F.round("oat_c", 6).alias("oat_c"), F.round("elec_j", 2).alias("elec_j"),
    )


@query(
    "grid_files_round_trip",
    """SELECT 'DF_' || o_orderkey AS case_id, CAST(70 + o_orderkey % 7 AS INTEGER) AS hvac_tstat,
CAST(month(o_orderdate) AS INTEGER) AS event_start FROM orders""",
)
def grid_files_round_trip(spark, sf_dir):
    order = F.col("o_orderkey")
    path = scratch_dir(spark, "grid")
    writers.write_grid(
        inputs.table(spark, sf_dir, "orders").select(
            text("DF_", order.cast("string")).alias("case_id"),
            (order % 7 + 70).cast("int").alias("hvac_tstat"),
            F.month("o_orderdate").alias("event_start"),
            F.lit(2).alias("event_hours"), F.lit(2).alias("precool_hours"),
            F.lit(0).alias("precool_deg"), F.lit(0).alias("reset_deg"),
        ),
        path,
    )
    return readers.read_grid(spark, path).select("case_id", "hvac_tstat", "event_start")


@query(
    "params_files_round_trip",
    """SELECT s_name AS "BaseModelId", 'Type' || s_nationkey AS bldg_type, 'DOE Ref ' || s_nationkey AS bldg_vintage,
'ASHRAE 169-2006-' || s_nationkey AS climate_zone, '4' AS time_step FROM supplier""",
)
def params_files_round_trip(spark, sf_dir):
    from demandloom.schemas import BASE_MODEL_NAMES

    path = scratch_dir(spark, "params")
    writers.write_params_json(base_models(spark, sf_dir), path)
    schema = ", ".join(f"{n} string" for n in BASE_MODEL_NAMES)
    return spark.read.schema(schema).json(path)
