"""Queries over argument checks, output requests, results and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom import constants as K
from demandloom.operators import logs, requests, validate
from demandloom.plans import inputs
from demandloom.plans.registry import query
from demandloom.session import fixed_table, scratch_dir
from demandloom.sources import stored_update
from demandloom.sources.readers import explode_keys


def shown(df, *keys):
    return df.select(*keys, "status", F.array_join("messages", "; ").alias("messages"))


def count_statuses(df):
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "setpoint_checks",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 20 - 100 AS c, l_quantity * -13 + 70 AS h FROM lineitem),
f AS (SELECT *, CASE WHEN c < 0 THEN 'warning' WHEN abs(c) > 500 THEN 'error' WHEN abs(c) > 50 THEN 'warning' END AS a,
CASE WHEN h > 0 THEN 'warning' WHEN abs(h) > 500 THEN 'error' WHEN abs(h) > 50 THEN 'warning' END AS b FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a = 'error' OR b = 'error' THEN 'error' WHEN a = 'warning' OR b = 'warning' THEN 'warning' ELSE 'ok' END AS status,
CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS INTEGER) AS n_messages FROM f""",
)
def setpoint_checks(spark, sf_dir):
    deltas = inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_quantity") * 20 - 100).alias("cooling"), (F.col("l_quantity") * -13 + 70).alias("heating"),
    )
    checked = validate.check_setpoint_deltas(deltas)
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "status", F.size("messages").alias("n_messages"))


WINDOW_SQL = """
w AS (SELECT o_orderkey, o_orderkey % 26 - 1 AS sh, o_custkey % 62 - 1 AS sm, o_custkey % 25 AS eh, o_orderkey % 61 AS em FROM orders)"""


def windows(spark, sf_dir):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey", (order % 26 - 1).alias("start_hour"), (customer % 62 - 1).alias("start_minute"),
        (customer % 25).alias("end_hour"), (order % 61).alias("end_minute"),
    )


FIELDS_SQL = (
    "CASE WHEN sh NOT BETWEEN 0 AND 23 THEN 'start_hour out of range' END, "
    "CASE WHEN sm NOT BETWEEN 0 AND 59 THEN 'start_minute out of range' END, "
    "CASE WHEN eh NOT BETWEEN 0 AND 23 THEN 'end_hour out of range' END, "
    "CASE WHEN em NOT BETWEEN 0 AND 59 THEN 'end_minute out of range' END"
)


def window_sql(order_tests: str) -> str:
    return (
        f"WITH {WINDOW_SQL}, m AS (SELECT o_orderkey, concat_ws('; ', {FIELDS_SQL}, {order_tests}) AS messages FROM w) "
        "SELECT o_orderkey, CASE WHEN messages = '' THEN 'ok' ELSE 'error' END AS status, messages FROM m"
    )


@query(
    "event_window_checks", window_sql("CASE WHEN eh * 60 + em < sh * 60 + sm THEN 'end before start' END")
)
def event_window_checks(spark, sf_dir):
    return shown(validate.check_event_window(windows(spark, sf_dir)), "o_orderkey")


@query(
    "event_window_checks_by_field",
    window_sql(
        "CASE WHEN eh < sh THEN 'end hour before start hour' END, "
        "CASE WHEN em < sm THEN 'end minute before start minute' END"
    ),
)
def event_window_checks_by_field(spark, sf_dir):
    return shown(validate.check_event_window(windows(spark, sf_dir), compat=True), "o_orderkey")


def percent_sql(p: str) -> str:
    return (
        f"CASE WHEN {p} > 100 THEN 'e' WHEN {p} = 0 THEN 'i' WHEN abs({p}) < 1 THEN 'w' "
        f"WHEN {p} > 90 THEN 'w' WHEN {p} < 0 THEN 'i' END"
    )


@query(
    "lighting_checks",
    f"""WITH v AS (SELECT p_partkey, p_size * 2.25e0 AS a, (p_partkey % 13) / 10e0 - 0.2 AS b, p_size - 20e0 AS c,
  p_partkey % 1440 AS s, p_size * 60 AS e FROM part),
f AS (SELECT *, [{percent_sql('a')}, {percent_sql('b')}, {percent_sql('c')}, CASE WHEN s > e THEN 'e' END] AS l FROM v)
SELECT p_partkey, CASE WHEN list_contains(l, 'e') THEN 'error' WHEN list_contains(l, 'w') THEN 'warning' ELSE 'ok' END AS status,
CAST(len(list_filter(l, lambda x: x IS NOT NULL)) AS INTEGER) AS n_messages FROM f""",
)
def lighting_checks(spark, sf_dir):
    part = F.col("p_partkey")
    rows = inputs.table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") * 2.25).alias("occupied"), ((part % 13) / 10.0 - 0.2).alias("unoccupied"),
        (F.col("p_size") - 20.0).alias("single"), (part % 1440).alias("start_min"), (F.col("p_size") * 60).alias("end_min"),
    )
    checked = validate.check_lighting(rows, ["occupied", "unoccupied", "single"])
    return checked.select("p_partkey", "status", F.size("messages").alias("n_messages"))


@query(
    "insulation_checks",
    """WITH v AS (SELECT c_custkey, c_acctbal / 50 - 40 AS percent, count(o_orderkey) AS n, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS area
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT CASE WHEN percent < -100 THEN 'error' WHEN n = 0 OR coalesce(area, 0) = 0 THEN 'not_applicable' ELSE 'ok' END AS status, count(*) AS n
FROM v GROUP BY 1""",
)
def insulation_checks(spark, sf_dir):
    area = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))
    found = inputs.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_surfaces"), F.sum(area).alias("area")
    )
    rows = inputs.table(spark, sf_dir, "customer").join(found, "c_custkey", "left").select(
        "c_custkey", (F.col("c_acctbal") / 50 - 40).alias("percent"),
        F.coalesce("n_surfaces", F.lit(0)).alias("n_surfaces"), "area",
    )
    return count_statuses(validate.check_insulation(rows))


RANGE_RULES = [
    ("c_acctbal", 0.0, 9000.0, True, False, None),
    ("c_nationkey", 0.0, 20.0, False, True, None),
    ("c_phone", 0.0, 1.0, True, True, 0.5),
]


@query(
    "range_checks",
    """WITH a AS (SELECT c_custkey, param, v FROM customer, LATERAL (VALUES ('c_acctbal', c_acctbal), ('c_nationkey', c_nationkey * 1e0),
  ('c_mktsegment', NULL), ('c_phone', NULL)) x(param, v))
SELECT c_custkey, param, CASE WHEN bad = '' THEN 'ok' ELSE 'error' END AS status, bad AS messages FROM (
SELECT c_custkey, param, CASE WHEN param = 'c_acctbal' AND v < 0 THEN 'c_acctbal too low' WHEN param = 'c_acctbal' AND v >= 9000 THEN 'c_acctbal too high'
WHEN param = 'c_phone' THEN 'c_phone is no number' WHEN param = 'c_nationkey' AND v <= 0 THEN 'c_nationkey too low' WHEN param = 'c_nationkey' AND v > 20 THEN 'c_nationkey too high' ELSE '' END AS bad FROM a)""",
)
def range_checks(spark, sf_dir):
    from demandloom.operators.design import design_long

    rules = fixed_table(
        spark,
        RANGE_RULES,
        "param string, low double, high double, low_inclusive boolean, high_inclusive boolean, default_value double",
    )
    customer = inputs.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", F.concat(F.lit("no. "), F.col("c_custkey")).alias("c_phone")
    )
    arguments = design_long(customer, "c_custkey")
    return shown(validate.check_ranges(arguments, rules), "c_custkey", "param")


@query(
    "choice_checks",
    "WITH v AS (SELECT p_partkey, ['hourly', 'daily', 'weekly', 'Timestep', 'runperiod'][p_size % 5 + 1] AS value FROM part) "
    "SELECT p_partkey, 'reporting_frequency' AS param, value FROM v WHERE value NOT IN "
    "('detailed', 'timestep', 'hourly', 'daily', 'monthly', 'runperiod')",
)
def choice_checks(spark, sf_dir):
    names = F.array(*(F.lit(n) for n in ["hourly", "daily", "weekly", "Timestep", "runperiod"]))
    arguments = inputs.table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("reporting_frequency").alias("param"), F.get(names, F.col("p_size") % 5).alias("value")
    )
    return validate.not_a_choice(arguments, validate.choice_table(spark))


@query(
    "request_checks",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN p_brand END AS key,
  CASE WHEN p_size > 48 THEN '' ELSE p_name END AS nm, CASE WHEN p_size < 3 THEN NULL ELSE p_type END AS fq FROM part)
SELECT p_partkey, CASE WHEN trim(coalesce(key, '')) = '' THEN '*' ELSE key END AS key,
CASE WHEN nm = '' OR fq IS NULL THEN 'error' ELSE 'ok' END AS status,
concat_ws('; ', CASE WHEN nm = '' THEN 'no name' END, CASE WHEN fq IS NULL THEN 'no reporting frequency' END,
  CASE WHEN trim(coalesce(key, '')) = '' THEN 'blank key changed to *' END) AS messages FROM r""",
)
def request_checks(spark, sf_dir):
    size = F.col("p_size")
    rows = inputs.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(size % 3 == 0, " ").when(size % 3 == 1, F.col("p_brand")).alias("key"),
        F.when(size > 48, "").otherwise(F.col("p_name")).alias("variable_name"),
        F.when(size >= 3, F.col("p_type")).alias("reporting_frequency"),
    )
    return shown(validate.clean_output_requests(rows), "p_partkey", "key")


@query(
    "choice_objects",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN 'building' ELSE 'C' || o_custkey END AS handle FROM orders),
k AS (SELECT 'C' || c_custkey AS handle, true AS known FROM customer WHERE c_acctbal > 0)
SELECT o_orderkey, handle = 'building' AS apply_to_building, CASE WHEN known OR handle = 'building' THEN 'ok' ELSE 'error' END AS status,
CASE WHEN known OR handle = 'building' THEN '' WHEN handle = '' THEN 'nothing was chosen' ELSE 'the choice was not found' END AS messages
FROM c LEFT JOIN k USING (handle)""",
)
def choice_objects(spark, sf_dir):
    order = F.col("o_orderkey")
    custkey = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    chosen = inputs.table(spark, sf_dir, "orders").select(
        F.lit(1).alias("model_id"), "o_orderkey",
        F.when(order % 7 == 0, "").when(order % 7 == 1, "building").otherwise(custkey).alias("handle"),
    )
    objects = inputs.table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(
        F.lit(1).alias("model_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("handle")
    )
    found = validate.resolve_choices(chosen, objects, building="building")
    return shown(found, "o_orderkey", "apply_to_building")


@query(
    "hours_of_operation_checks",
    """WITH v AS (SELECT o_orderkey, (o_orderkey % 24) * 1e0 AS s, (o_custkey % 24) * 1e0 AS f, (o_orderkey % 21) - 10e0 AS d FROM orders),
n AS (SELECT *, CASE WHEN s <= f THEN f - s ELSE f - s + 24 END + d AS len FROM v)
SELECT o_orderkey, len AS new_length, CASE WHEN len < 0 OR len > 24 THEN 'error' ELSE 'ok' END AS status,
CASE WHEN len < 0 THEN 'less than no hours of operation' WHEN len > 24 THEN 'more than 24 hours of operation' ELSE '' END AS messages FROM n""",
)
def hours_of_operation_checks(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 24).cast("double").alias("start"),
        (F.col("o_custkey") % 24).cast("double").alias("finish"), (F.col("o_orderkey") % 21 - 10.0).alias("delta_length"),
    )
    return shown(validate.check_hours_of_operation(rows), "o_orderkey", "new_length")


@query(
    "typed_arguments",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 15 THEN 'many' ELSE CAST(p_size AS VARCHAR) END AS ts,
  CASE WHEN p_size > 40 THEN NULL ELSE CAST(p_retailprice AS VARCHAR) END AS factor FROM part)
SELECT p_partkey, coalesce(CASE WHEN ts IS NULL THEN 4 ELSE TRY_CAST(ts AS INTEGER) END, -1) AS timestep,
CASE WHEN factor IS NULL THEN 1.2e0 ELSE TRY_CAST(factor AS DOUBLE) END AS sizing_factor,
CASE WHEN ts = 'many' THEN 'error' ELSE 'ok' END AS status FROM t""",
)
def typed_arguments(spark, sf_dir):
    size = F.col("p_size")
    rows = inputs.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(size < 10, None).when(size < 15, "many").otherwise(size.cast("string")).alias("timestep"),
        F.when(size <= 40, F.col("p_retailprice").cast("string")).alias("sizing_factor"),
    )
    typed = validate.typed_arguments(rows, {"timestep": ("int", 4), "sizing_factor": ("double", 1.2)})
    return typed.select("p_partkey", F.coalesce("timestep", F.lit(-1)).alias("timestep"), "sizing_factor", "status")


@query(
    "change_report",
    """WITH o AS (SELECT p_partkey AS model_id, CAST(p_size AS VARCHAR) AS s, p_brand AS b FROM part WHERE p_partkey % 7 > 0),
n AS (SELECT p_partkey AS model_id, CAST(p_size + 2 AS VARCHAR) AS s2, upper(p_brand) AS b2 FROM part WHERE p_partkey % 5 > 0),
j AS (SELECT * FROM o FULL JOIN n USING (model_id))
SELECT model_id, 'p_size' AS param, s AS old_value, s2 AS new_value FROM j UNION ALL SELECT model_id, 'p_brand', b, b2 FROM j""",
)
def change_report(spark, sf_dir):
    old = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), "p_size", "p_brand")
    new = old.where(F.col("model_id") % 5 > 0).select(
        "model_id", (F.col("p_size") + 2).alias("p_size"), F.upper("p_brand").alias("p_brand")
    )
    return validate.change_report(old.where(F.col("model_id") % 7 > 0), new, ["p_size", "p_brand"])


# --- requests and results --------------------------------------------------


def output_requests(spark, sf_dir):
    size = F.col("p_size")
    return inputs.table(spark, sf_dir, "part").select(
        (size % 5).alias("model_id"), "p_partkey",
        F.when(size % 4 > 0, F.concat(F.col("p_brand"), F.lit(" , "), F.col("p_type"))).alias("key"),
        F.when(size % 9 == 0, requests.THREE_DAYS_PER_MONTH).when(size % 3 == 0, F.col("p_type")).alias("reporting_schedule"),
    )


REQUEST_SQL = """
r AS (SELECT p_size % 5 AS model_id, p_partkey, unnest(CASE WHEN p_size % 4 > 0 THEN [p_brand, p_type] ELSE [NULL] END) AS key,
  CASE WHEN p_size % 9 = 0 THEN 'reporting_schedule_3_days_per_month' WHEN p_size % 3 = 0 THEN p_type END AS sched FROM part)"""


@query(
    "request_keys",
    f"WITH {REQUEST_SQL} SELECT p_partkey, coalesce(key, 'all') AS key FROM r",
)
def request_keys(spark, sf_dir):
    rows = explode_keys(output_requests(spark, sf_dir))
    return rows.select("p_partkey", F.coalesce("key", F.lit("all")).alias("key"))


@query(
    "request_counts",
    f"WITH {REQUEST_SQL} SELECT model_id, count(*) AS n_requested, count(*) FILTER (sched IS NULL OR "
    "sched = 'reporting_schedule_3_days_per_month' OR (model_id, sched) IN "
    "(SELECT (p_size % 5, p_type) FROM part WHERE p_size > 45)) AS n_added FROM r GROUP BY 1",
)
def request_counts(spark, sf_dir):
    schedules = inputs.table(spark, sf_dir, "part").where(F.col("p_size") > 45).select(
        (F.col("p_size") % 5).alias("model_id"), F.col("p_type").alias("name")
    )
    matched = requests.match_reporting_schedule(explode_keys(output_requests(spark, sf_dir)), schedules)
    return requests.request_counts(matched)


UPSERT_SQL = """e AS (SELECT s_nationkey AS model_id, 'm' || s_suppkey AS name, 'hourly' AS f FROM supplier WHERE s_suppkey % 3 > 0),
q AS (SELECT s_nationkey AS model_id, 'm' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'daily' ELSE 'hourly' END AS w FROM supplier WHERE s_acctbal > 2000)"""


def meters_and_requests(spark, sf_dir):
    supplier = inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("model_id"), F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("name"),
        "s_suppkey", "s_acctbal",
    )
    existing = supplier.where(F.col("s_suppkey") % 3 > 0).select(
        "model_id", "name", F.lit("hourly").alias("reporting_frequency")
    )
    wanted = supplier.where(F.col("s_acctbal") > 2000).select(
        "model_id", "name",
        F.when(F.col("s_suppkey") % 2 == 0, "daily").otherwise("hourly").alias("reporting_frequency"),
    )
    return existing, wanted


@query(
    "request_upsert",
    f"""WITH {UPSERT_SQL}
SELECT model_id, name, coalesce(w, f) AS reporting_frequency, CASE WHEN f IS NULL THEN 'added' WHEN w IS NULL OR w = f THEN 'kept' ELSE 'changed' END AS action
FROM e FULL JOIN q USING (model_id, name)""",
)
def request_upsert(spark, sf_dir):
    return requests.upsert_meters(*meters_and_requests(spark, sf_dir))


@query(
    "request_upsert_stored",
    f"WITH {UPSERT_SQL} SELECT model_id, name, coalesce(w, f) AS reporting_frequency FROM e FULL JOIN q USING (model_id, name)",
)
def request_upsert_stored(spark, sf_dir):
    existing, wanted = meters_and_requests(spark, sf_dir)
    table = stored_update.write_table(existing, scratch_dir(spark, "meters"), ("model_id", "name"))
    stored_update.update(table, wanted, requests.upsert_meters)
    return table.read(spark)


@query(
    "first_step_with_arg",
    """SELECT l_orderkey AS run_id, CAST(l_linenumber AS INTEGER) AS step_pos, measure, value FROM (
SELECT *, 'part' || l_partkey AS measure, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'part' || l_partkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS rn
FROM lineitem WHERE l_returnflag = 'R') WHERE rn = 1""",
)
def first_step_with_arg(spark, sf_dir):
    values = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_pos"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("measure"),
        F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("int").cast("string").alias("value"),
    )
    return requests.first_step_with(values, "R")


# --- logs ----------------------------------------------------------------------

LOG_LEVELS = ["Info", "Warn", "Error", "Debug"]


def log(spark, sf_dir):
    levels = F.array(*(F.lit(v) for v in LOG_LEVELS))
    return inputs.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("run_id"), F.concat_ws(".", "source", "lang").alias("channel"),
        F.get(levels, (F.col("doc_id") % 4).cast("int")).alias("level"), F.col("text").alias("message"), "doc_id",
    )


LOG_SQL = f"""
d AS (SELECT doc_id, lang AS run_id, source || '.' || lang AS channel, text AS message, {LOG_LEVELS}[doc_id % 4 + 1] AS level FROM documents),
kept AS (SELECT * FROM d WHERE regexp_matches(channel, '^[a-s].*') AND NOT contains(message, 'the the') AND NOT contains(message, 'UseWeatherFile')
  AND NOT contains(channel, 'Translator'))"""


def kept_log(spark, sf_dir):
    return logs.relevant(log(spark, sf_dir), "^[a-s].*", ["the the", "UseWeatherFile"], K.SKIP_CHANNEL_PARTS)


@query(
    "log_levels",
    f"WITH {LOG_SQL} SELECT run_id, CASE level WHEN 'Info' THEN 'info' WHEN 'Warn' THEN 'warning' ELSE 'error' END AS shown_as, "
    "count(*) AS n_messages FROM kept WHERE level <> 'Debug' GROUP BY 1, 2",
)
def log_levels(spark, sf_dir):
    return logs.count_levels(logs.classify(kept_log(spark, sf_dir)))


@query(
    "log_texts",
    f"WITH {LOG_SQL} SELECT doc_id, CASE level WHEN 'Warn' THEN 'warning' WHEN 'Error' THEN 'error' ELSE 'info' END AS shown_as, "
    "md5(CASE level WHEN 'Info' THEN message WHEN 'Debug' THEN 'DEBUG - ' || message ELSE '[' || channel || '] ' || message END) AS text_md5 FROM kept",
)
def log_texts(spark, sf_dir):
    classified = logs.classify(kept_log(spark, sf_dir), debug=True)
    return classified.select("doc_id", "shown_as", F.md5("text").alias("text_md5"))
