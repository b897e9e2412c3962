"""Queries over day profiles, rule sets and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions import profiles as P
from demandloom.operators import schedule, series, shared
from demandloom.plans import inputs
from demandloom.plans.registry import query

PROFILE_SQL = inputs.PROFILE_SQL


def points(spark, sf_dir):
    """Breakpoints: order as profile, line number as time, largest quantity as value."""
    return inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("profile_id"),
        (F.col("l_linenumber") * 180).alias("until_min"),
        F.col("l_quantity").alias("value"),
    )


def to_midnight(profiles):
    """Move the last breakpoint of each profile to 24:00."""
    last = F.size("points") - 1
    return profiles.withColumn(
        "points",
        F.transform(
            "points",
            lambda p, i: P.point(F.when(i == last, F.lit(P.DAY)).otherwise(p["until_min"]), p["value"]),
        ),
    )


def profiles(spark, sf_dir):
    shaped = to_midnight(schedule.to_profiles(points(spark, sf_dir)))
    parity = F.col("profile_id") % 4
    return shaped.withColumn(
        "kind",
        F.when(parity == 0, "default").when(parity == 1, "rule").when(parity == 2, "summer").otherwise("winter"),
    )


KIND_SQL = "['default', 'rule', 'summer', 'winter'][profile_id % 4 + 1]"


def out(df, digits=6):
    return schedule.to_points(df).withColumn("value", F.round("value", digits))


@query("profile_points", f"WITH {PROFILE_SQL} SELECT * FROM prof")
def profile_points(spark, sf_dir):
    return out(profiles(spark, sf_dir))


@query(
    "profile_day_shift",
    f"WITH {PROFILE_SQL} SELECT profile_id, until_min, round(CASE WHEN {KIND_SQL} = 'winter' THEN value "
    "ELSE value + -3 / 1.8e0 END, 6) AS value FROM prof",
)
def profile_day_shift(spark, sf_dir):
    return out(schedule.shift_setpoints(profiles(spark, sf_dir), -3, "cooling", alter_design_days=True))


# All breakpoints plus window start and end, with the value in force at each.
def cut_sql(start: int, end: int) -> str:
    return PROFILE_SQL + f""",
cuts AS (SELECT profile_id, until_min FROM prof UNION SELECT profile_id, unnest([{start}, {end}]) FROM prof),
cut AS (
  SELECT c.profile_id, CAST(c.until_min AS INTEGER) AS until_min,
         (SELECT arg_min(p.value, p.until_min) FROM prof p
          WHERE p.profile_id = c.profile_id AND p.until_min >= c.until_min) AS value
  FROM cuts c)"""


@query(
    "profile_window_shift",
    f"WITH {cut_sql(720, 1080)} SELECT profile_id, until_min, round(CASE WHEN {KIND_SQL} IN ('default', 'rule') "
    "AND until_min > 720 AND until_min <= 1080 THEN value + 4 / 1.8e0 ELSE value END, 6) AS value FROM cut "
    f"WHERE {KIND_SQL} IN ('default', 'rule') OR EXISTS (SELECT 1 FROM prof p "
    "WHERE p.profile_id = cut.profile_id AND p.until_min = cut.until_min)",
)
def profile_window_shift(spark, sf_dir):
    return out(schedule.shift_setpoints_in_window(profiles(spark, sf_dir), 4, 720, 1080))


def lighting_sql(factor: str) -> str:
    return (
        f"WITH {cut_sql(780, 900)}, pct AS (SELECT CASE WHEN bool_or(o_orderstatus = 'F') THEN 30e0 ELSE 95e0 END AS percent, "
        "o_custkey AS space_type FROM orders GROUP BY o_custkey), "
        "own AS (SELECT o_orderkey AS profile_id, percent FROM orders JOIN pct ON o_custkey = space_type) "
        "SELECT profile_id, until_min, round(CASE WHEN until_min > 780 AND until_min <= 900 "
        f"THEN value * ({factor}) ELSE value END, 6) AS value FROM cut JOIN own USING (profile_id)"
    )


def reduced_lights(spark, sf_dir, compat):
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("profile_id"), F.col("o_custkey").alias("space_type"),
        (F.col("o_orderstatus") == "F").alias("has_people"),
    )
    percent = schedule.lighting_percent(orders, 30, 95)
    lights = profiles(spark, sf_dir).join(orders.drop("has_people"), "profile_id").join(percent, "space_type")
    return out(schedule.reduce_lighting(lights, "percent", 780, 900, compat=compat))


@query("profile_lighting_reduction", lighting_sql("1 - percent / 100"))
def profile_lighting_reduction(spark, sf_dir):
    return reduced_lights(spark, sf_dir, compat=False)


@query("profile_lighting_remaining", lighting_sql("percent / 100"))
def profile_lighting_remaining(spark, sf_dir):
    return reduced_lights(spark, sf_dir, compat=True)


@query(
    "profile_scale",
    f"WITH {PROFILE_SQL} SELECT profile_id, until_min, round(value * 1.25e0 + 2, 6) AS value FROM prof",
)
def profile_scale(spark, sf_dir):
    scaled = schedule.adjust_values(profiles(spark, sf_dir), 1.25, "Multiplier")
    return out(schedule.adjust_values(scaled, 2.0, "Sum"))


@query(
    "profile_conditional",
    f"WITH {PROFILE_SQL} SELECT profile_id, until_min, round(CASE WHEN value <= 5 THEN value "
    "ELSE greatest(value * CASE WHEN value < 25 THEN 0.5e0 ELSE 0.9e0 END, 5) END, 6) AS value FROM prof",
)
def profile_conditional(spark, sf_dir):
    return out(schedule.adjust_conditional(profiles(spark, sf_dir), 25.0, 0.5, 0.9, 5.0))


@query(
    "profile_time_scale",
    f"WITH {cut_sql(630, 1005)} SELECT profile_id, until_min, round(CASE WHEN until_min > 630 AND until_min <= 1005 "
    "THEN value * 0.8e0 ELSE value * 1.1e0 END, 6) AS value FROM cut",
)
def profile_time_scale(spark, sf_dir):
    return out(schedule.adjust_by_time(profiles(spark, sf_dir), "1030", "1645", 0.8, 1.1))


@query(
    "profile_time_replace",
    f"WITH {cut_sql(630, 1005)} SELECT profile_id, until_min, CASE WHEN until_min > 630 AND until_min <= 1005 "
    "THEN 7e0 ELSE value END AS value FROM cut",
)
def profile_time_replace(spark, sf_dir):
    edited = schedule.adjust_by_time(
        profiles(spark, sf_dir), "1030", "1645", 7.0, F.lit(None).cast("double"), "Replace"
    )
    return out(edited)


@query(
    "profile_rate",
    f"WITH {PROFILE_SQL} SELECT profile_id, until_min, round(coalesce(abs(value - lag(value) OVER w) / "
    "((until_min - lag(until_min) OVER w) / 60e0), 0), 6) AS value FROM prof "
    "WINDOW w AS (PARTITION BY profile_id ORDER BY until_min)",
)
def profile_rate(spark, sf_dir):
    return out(schedule.rate_of_change(profiles(spark, sf_dir)))


@query(
    "profile_value_at",
    f"WITH {PROFILE_SQL} SELECT profile_id, CAST(t AS INTEGER) AS minute, arg_min(value, until_min) AS value "
    "FROM prof, (SELECT unnest([1, 180, 181, 720, 1440]) AS t) WHERE until_min >= t GROUP BY 1, 2",
)
def profile_value_at(spark, sf_dir):
    minutes = F.explode(F.array(*(F.lit(t) for t in (1, 180, 181, 720, 1440))))
    day = profiles(spark, sf_dir).withColumn("minute", minutes)
    return day.select("profile_id", "minute", P.value_at(F.col("points"), F.col("minute")).alias("value"))


@query(
    "profile_minmax",
    f"WITH {PROFILE_SQL} SELECT profile_id % 100 AS schedule_id, min(value) AS min_value, max(value) AS max_value "
    f"FROM prof WHERE {KIND_SQL} IN ('default', 'rule') GROUP BY 1",
)
def profile_minmax(spark, sf_dir):
    owned = profiles(spark, sf_dir).withColumn("schedule_id", F.col("profile_id") % 100)
    return schedule.min_max(owned)


@query(
    "setpoint_ranges",
    f"""WITH {PROFILE_SQL},
v AS (SELECT profile_id % 50 AS model_id, {KIND_SQL} AS side, value AS a, value + 2 / 1.8e0 AS b FROM prof),
r AS (SELECT model_id, side, min(a) AS i0, max(a) AS i1, min(b) AS f0, max(b) AS f1 FROM v GROUP BY 1, 2)
SELECT model_id, side, printf('%.1f', i0 * 1.8e0 + 32) AS initial_min, printf('%.1f', i1 * 1.8e0 + 32) AS initial_max,
CASE WHEN side = 'rule' THEN 'NA' ELSE printf('%.1f', f0 * 1.8e0 + 32) END AS final_min,
CASE WHEN side = 'rule' THEN 'NA' ELSE printf('%.1f', f1 * 1.8e0 + 32) END AS final_max, true AS applicable FROM r""",
)
def setpoint_ranges(spark, sf_dir):
    before = profiles(spark, sf_dir).withColumns(
        {"model_id": F.col("profile_id") % 50, "side": F.col("kind")}
    )
    after = schedule.edit(before, P.map_values(F.col("points"), lambda v: v + 2 / 1.8))
    return schedule.setpoint_ranges(before, after.where(F.col("side") != "rule"))


@query(
    "profile_merge",
    """WITH pts AS (
  SELECT l_returnflag || l_linestatus AS group_id, l_orderkey AS profile_id, l_linenumber * 180 AS u, max(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2, 3),
prof AS (SELECT group_id, profile_id, value, CAST(CASE WHEN u = max(u) OVER (PARTITION BY group_id, profile_id) THEN 1440
  ELSE u END AS INTEGER) AS until_min FROM pts),
seg AS (SELECT *, lag(until_min, 1, 0) OVER (PARTITION BY group_id, profile_id ORDER BY until_min) AS begin_min,
        1 + profile_id % 3 AS w FROM prof),
cuts AS (SELECT DISTINCT group_id, until_min FROM prof)
SELECT c.group_id, c.until_min, round(sum(s.w * s.value) / sum(s.w), 6) AS value
FROM cuts c JOIN seg s ON s.group_id = c.group_id AND s.begin_min < c.until_min AND c.until_min <= s.until_min
GROUP BY 1, 2""",
)
def profile_merge(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("group_id"),
        F.col("l_orderkey").alias("profile_id"),
        (F.col("l_linenumber") * 180).alias("until_min"),
        F.col("l_quantity").alias("value"),
    )
    shaped = to_midnight(schedule.to_profiles(rows, ("group_id", "profile_id")))
    weighted = shaped.withColumn("weight", F.col("profile_id") % 3 + 1)
    merged = schedule.merge_weighted(weighted, ("group_id",))
    return merged.withColumn("value", F.round("value", 6))


@query(
    "distinct_day_shapes",
    f"WITH {PROFILE_SQL}, s AS (SELECT profile_id, string_agg(until_min || ':' || CAST(value AS INTEGER), ' ' ORDER BY until_min) AS shape "
    "FROM prof GROUP BY 1) SELECT profile_id % 10 AS schedule_id, shape, count(*) AS n_uses FROM s GROUP BY 1, 2",
)
def distinct_day_shapes(spark, sf_dir):
    owned = profiles(spark, sf_dir).withColumn("schedule_id", F.col("profile_id") % 10)
    shape = F.transform(
        "points", lambda p: F.concat_ws(":", p["until_min"].cast("string"), p["value"].cast("int").cast("string"))
    )
    return schedule.distinct_profiles(owned).select(
        "schedule_id", F.array_join(shape, " ").alias("shape"), "n_uses"
    )


# Whole quantities in tens, so that many profiles are the same step function.
TENS_SQL = f"""{PROFILE_SQL},
tens AS (SELECT profile_id, until_min, CAST(floor(value / 10) AS DOUBLE) AS value FROM prof),
needed AS (SELECT profile_id, until_min, value FROM (
  SELECT *, lead(value) OVER (PARTITION BY profile_id ORDER BY until_min) AS next FROM tens) WHERE next IS NULL OR next <> value),
shapes AS (SELECT profile_id, string_agg(until_min || ':' || CAST(value AS INTEGER), ' ' ORDER BY until_min) AS shape FROM needed GROUP BY 1)"""


def in_tens(spark, sf_dir):
    return profiles(spark, sf_dir).withColumn("points", P.map_values(F.col("points"), lambda v: F.floor(v / 10)))


@query(
    "shared_day_profiles",
    f"WITH {TENS_SQL} SELECT shape, count(*) AS n_uses, min(profile_id) AS first_profile FROM shapes GROUP BY 1",
)
def shared_day_profiles(spark, sf_dir):
    days = in_tens(spark, sf_dir)
    shape = F.array_join(
        F.transform("points", lambda p: F.concat_ws(":", p["until_min"].cast("string"), p["value"].cast("int").cast("string"))), " "
    )
    owners = shared.links(days).groupBy("shape_id").agg(F.min("profile_id").alias("first_profile"))
    return shared.dictionary(days).join(owners, "shape_id").select(shape.alias("shape"), "n_uses", "first_profile")


@query(
    "shared_day_profiles_edited",
    f"""WITH {TENS_SQL}, edited AS (SELECT profile_id, until_min, least(value, 2) + 0.5e0 AS value FROM needed)
SELECT profile_id, until_min, value FROM (
  SELECT *, lead(value) OVER (PARTITION BY profile_id ORDER BY until_min) AS next FROM edited) WHERE next IS NULL OR next <> value""",
)
def shared_day_profiles_edited(spark, sf_dir):
    """Each content is edited once, contents that became equal become one, then all profiles get theirs."""
    days = in_tens(spark, sf_dir)
    edit = P.map_values(F.col("points"), lambda v: F.least(v, F.lit(2.0)) + 0.5)
    owned, shapes = shared.readdress(shared.links(days), shared.dictionary(days).withColumn("points", edit))
    return schedule.to_points(shared.expand(owned, shapes))


@query(
    "shared_schedule_clones",
    """WITH entry AS (SELECT l_orderkey AS schedule_id, l_returnflag AS kind, floor(l_quantity / 10) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT schedule_id, string_agg(kind || v || 'x' || n, ' ' ORDER BY kind, v) AS content FROM entry GROUP BY 1),
f AS (SELECT schedule_id, min(schedule_id) OVER (PARTITION BY content) AS shared_id FROM s)
SELECT shared_id, count(*) AS n_users, shared_id || ' adjusted' AS new_shared_id FROM orders JOIN f ON o_orderkey = schedule_id GROUP BY 1""",
)
def shared_schedule_clones(spark, sf_dir):
    """An order uses its own schedule, whose entries are its line items' flags and tens of quantity."""
    items = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("profile_id"), F.col("l_orderkey").alias("schedule_id"), F.col("l_returnflag").alias("kind"),
        F.array(P.point(F.lit(P.DAY), F.floor(F.col("l_quantity") / 10))).alias("points"),
    )
    entries = shared.links(items, ("schedule_id", "kind"))
    same = shared.same_schedules(entries, ("kind", "shape_id"))
    users = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("schedule_id")).join(same, "schedule_id")
    return schedule.clones(users, "shared_id", F.lit(" adjusted"), keys=())


YEAR = 2017
# Half hours in 8192 days, of which at most two runs each are stitched.
DAY_BLOCKS = (48 * 8192,)

RULES_SQL = f"""
item AS (SELECT l_suppkey AS schedule_id, (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS rule_order, l_returnflag AS profile_id,
  l_linenumber AS line, make_date({YEAR}, month(l_shipdate), least(day(l_shipdate), 28)) AS start_date,
  CAST(l_quantity AS INTEGER) AS days FROM lineitem),
rules AS (SELECT *, CASE WHEN start_date + days > DATE '{YEAR}-12-31' THEN start_date + days - 365
  ELSE start_date + days END AS end_date FROM item),
cal AS (SELECT CAST(unnest(generate_series(DATE '{YEAR}-01-01', DATE '{YEAR}-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
hit AS (SELECT r.schedule_id, c.date, arg_min(profile_id, rule_order) AS profile_id
  FROM rules r JOIN cal c ON CASE WHEN start_date <= end_date THEN c.date BETWEEN start_date AND end_date
    ELSE c.date >= start_date OR c.date <= end_date END
  WHERE (dayofweek(c.date) + line) % 2 = 0 GROUP BY 1, 2),
days AS (SELECT s.schedule_id, c.date, coalesce(h.profile_id, 'D') AS profile_id
  FROM (SELECT DISTINCT l_suppkey AS schedule_id FROM lineitem) s CROSS JOIN cal c
  LEFT JOIN hit h ON h.schedule_id = s.schedule_id AND h.date = c.date)"""


def ruleset(spark, sf_dir):
    """Rules per supplier: ship date as start, quantity as length, line number picks the weekdays."""
    items = inputs.table(spark, sf_dir, "lineitem")
    start = F.make_date(
        F.lit(YEAR), F.month("l_shipdate"), F.least(F.dayofmonth("l_shipdate"), F.lit(28))
    )
    end = F.date_add(start, F.col("l_quantity").cast("int"))
    wrapped = F.when(F.year(end) > YEAR, F.date_sub(end, 365)).otherwise(end)
    rules = items.select(
        F.col("l_suppkey").alias("schedule_id"),
        (
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000
            + F.round(F.col("l_extendedprice") * 100).cast("long")
        ).alias("rule_order"),
        F.col("l_returnflag").alias("profile_id"),
        start.alias("start_date"),
        wrapped.alias("end_date"),
        F.transform(
            F.sequence(F.lit(0), F.lit(6)), lambda d: (d + F.col("l_linenumber")) % 2 == 0
        ).alias("dow"),
    )
    defaults = items.select(F.col("l_suppkey").alias("schedule_id")).distinct()
    return rules, defaults.withColumn("profile_id", F.lit("D"))


def ruleset_days(spark, sf_dir):
    rules, defaults = ruleset(spark, sf_dir)
    return schedule.daily_profiles(rules, defaults, YEAR)


@query(
    "ruleset_year",
    f"WITH {RULES_SQL} SELECT schedule_id, strftime(date, '%Y-%m-%d') AS date, profile_id FROM days",
)
def ruleset_year(spark, sf_dir):
    days = ruleset_days(spark, sf_dir)
    return days.withColumn("date", F.col("date").cast("string"))


def half_hour_sql(per_day: int) -> str:
    return f"""WITH {RULES_SQL},
pts AS (SELECT l_suppkey AS schedule_id, l_returnflag AS profile_id, l_linenumber * 180 AS u, max(l_extendedprice) AS value
  FROM lineitem GROUP BY 1, 2, 3
  UNION ALL SELECT l_suppkey, 'D', 1440, max(l_extendedprice) FROM lineitem GROUP BY 1),
prof AS (SELECT schedule_id, profile_id, value, CASE WHEN u = max(u) OVER w THEN 1440 ELSE u END AS until_min
  FROM pts WINDOW w AS (PARTITION BY schedule_id, profile_id)),
seg AS (SELECT *, lag(until_min, 1, 0) OVER (PARTITION BY schedule_id, profile_id ORDER BY until_min) AS begin_min FROM prof)
SELECT d.schedule_id, CAST(h AS INTEGER) AS half_hour, count(*) AS n, round(avg(s.value), 4) AS mean_value
FROM days d JOIN seg s ON s.schedule_id = d.schedule_id AND s.profile_id = d.profile_id
JOIN range({per_day}) r(h) ON (h + 1) * 30 > s.begin_min AND (h + 1) * 30 <= s.until_min
GROUP BY 1, 2"""


def ruleset_shapes(spark, sf_dir):
    items = inputs.table(spark, sf_dir, "lineitem")
    keys = ("schedule_id", "profile_id")
    by_flag = items.select(
        F.col("l_suppkey").alias("schedule_id"), F.col("l_returnflag").alias("profile_id"),
        (F.col("l_linenumber") * 180).alias("until_min"), F.col("l_extendedprice").alias("value"),
    )
    flat = by_flag.select("schedule_id", F.lit("D").alias("profile_id"), F.lit(1440).alias("until_min"), "value")
    return to_midnight(schedule.to_profiles(by_flag.unionByName(flat), keys))


def half_hours(spark, sf_dir, compat=False):
    return schedule.half_hour_values(ruleset_days(spark, sf_dir), ruleset_shapes(spark, sf_dir), compat=compat)


def half_hour_means(values):
    return values.groupBy("schedule_id", "half_hour").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value")
    )


@query("ruleset_half_hours", half_hour_sql(48))
def ruleset_half_hours(spark, sf_dir):
    return half_hour_means(half_hours(spark, sf_dir))


@query("ruleset_half_hours_without_midnight", half_hour_sql(47))
def ruleset_half_hours_without_midnight(spark, sf_dir):
    return half_hour_means(half_hours(spark, sf_dir, compat=True))


def half_hour_intervals(spark, sf_dir):
    """Half-hour values as one series per schedule, numbered from 1970 on, and its variable intervals: the days' runs stitched."""
    runs = schedule.half_hour_runs(ruleset_days(spark, sf_dir), ruleset_shapes(spark, sf_dir))
    midnight = F.unix_date("date").cast("long") * 48
    numbered = runs.select(
        "schedule_id", (midnight + F.col("first_half_hour")).alias("begin_step"), (midnight + F.col("last_half_hour")).alias("end_step"), "value"
    )
    return series.stitch_runs(numbered, ["schedule_id"], blocks=DAY_BLOCKS, within=48)


SERIES_SQL = half_hour_sql(48).rpartition("SELECT d.schedule_id")[0] + """,
steps AS (SELECT d.schedule_id, datediff('day', DATE '1970-01-01', CAST(d.date AS DATE)) * 48 + h AS step, s.value
  FROM days d JOIN seg s ON s.schedule_id = d.schedule_id AND s.profile_id = d.profile_id
  JOIN range(48) r(h) ON (h + 1) * 30 > s.begin_min AND (h + 1) * 30 <= s.until_min),
marked AS (SELECT *, CASE WHEN lag(step) OVER w = step - 1 AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS starts
  FROM steps WINDOW w AS (PARTITION BY schedule_id ORDER BY step)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY schedule_id ORDER BY step) AS run FROM marked)"""


@query(
    "schedule_intervals",
    f"{SERIES_SQL} SELECT schedule_id, min(step) AS begin_step, max(step) AS end_step, any_value(value) AS value FROM numbered GROUP BY schedule_id, run",
)
def schedule_intervals(spark, sf_dir):
    return half_hour_intervals(spark, sf_dir)


@query("schedule_intervals_unfolded", half_hour_sql(48))
def schedule_intervals_unfolded(spark, sf_dir):
    steps = series.from_intervals(half_hour_intervals(spark, sf_dir), ["schedule_id"])
    return half_hour_means(steps.withColumn("half_hour", F.pmod("step", F.lit(48)).cast("int")))


@query(
    "reporting_calendar",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders),
d AS (SELECT year, CAST(unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date FROM y)
SELECT CAST(year AS INTEGER) AS year, strftime(date, '%Y-%m-%d') AS date FROM d
WHERE day(date) <= 7 AND dayofweek(date) IN (0, 2, 6)""",
)
def reporting_calendar(spark, sf_dir):
    years = inputs.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    days = schedule.reporting_calendar(years)
    return days.withColumn("date", F.col("date").cast("string"))


@query(
    "simple_schedules",
    """SELECT s_suppkey AS schedule_id, kind, CAST(t AS INTEGER) AS until_min, v AS value FROM supplier, LATERAL (VALUES
('default', 60 * (s_nationkey % 12) + 345, 0.2e0), ('default', 1440, round(s_acctbal, 2)),
('summer', 1440, 1e0), ('winter', 1440, 0e0)) x(kind, t, v)""",
)
def simple_schedules(spark, sf_dir):
    specs = inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("schedule_id"),
        F.create_map(
            F.lit(24.0), F.round("s_acctbal", 2), F.col("s_nationkey") % 12 + F.lit(5.75), F.lit(0.2)
        ).alias("default"),
        F.lit(None).cast("map<double,double>").alias("summer"),
        F.lit(None).cast("map<double,double>").alias("winter"),
    )
    return schedule.to_points(schedule.simple_schedules(specs), ("schedule_id", "kind"))


def compact_specs(spark, sf_dir):
    def pairs(*hv):
        return F.array(*(F.struct(h.alias("hour"), v.alias("value")) for h, v in hv))

    k = F.col("s_nationkey")
    full = F.lit(24.0)
    return inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("schedule_id"),
        pairs((full, F.col("s_acctbal"))).alias("default_day"),
        pairs((full, F.lit(1.0))).alias("summer"),
        F.lit(None).cast("array<struct<hour:double,value:double>>").alias("winter"),
        F.array(
            F.struct(
                F.lit("weekend").alias("name"),
                F.concat(F.lit("1/1-"), (k % 12 + 1).cast("string"), F.lit("/28")).alias("dates"),
                F.when(k % 2 == 0, "Sat/Sun").otherwise("Sat").alias("days"),
                pairs((k % 10 + F.lit(6.5), F.lit(0.1)), (full, F.lit(0.3))).alias("points"),
            )
        ).alias("rules"),
    )


@query(
    "compact_ruleset_profiles",
    """SELECT s_suppkey AS schedule_id, kind, profile_id, CAST(t AS INTEGER) AS until_min, v AS value FROM supplier, LATERAL (VALUES
('default', 'default', 1440, s_acctbal), ('summer', 'summer', 1440, 1e0),
('rule', 'weekend', 60 * (s_nationkey % 10) + 390, 0.1e0), ('rule', 'weekend', 1440, 0.3e0)) x(kind, profile_id, t, v)""",
)
def compact_ruleset_profiles(spark, sf_dir):
    shaped = schedule.ruleset_profiles(compact_specs(spark, sf_dir))
    return schedule.to_points(shaped, ("schedule_id", "kind", "profile_id"))


@query(
    "compact_ruleset_rules",
    """SELECT s_suppkey AS schedule_id, CAST(0 AS INTEGER) AS rule_order, 'weekend' AS profile_id, '2017-01-01' AS start_date,
strftime(make_date(2017, s_nationkey % 12 + 1, 28), '%Y-%m-%d') AS end_date,
CASE WHEN s_nationkey % 2 = 0 THEN 'true,false,false,false,false,false,true'
ELSE 'false,false,false,false,false,false,true' END AS dow FROM supplier""",
)
def compact_ruleset_rules(spark, sf_dir):
    rules = schedule.ruleset_rules(compact_specs(spark, sf_dir), 2017)
    return rules.select(
        "schedule_id", "rule_order", "profile_id",
        *(F.col(c).cast("string").alias(c) for c in ("start_date", "end_date")),
        F.array_join(F.transform("dow", lambda d: d.cast("string")), ",").alias("dow"),
    )


@query(
    "exterior_setback",
    """WITH s AS (SELECT o_orderkey, o_orderkey % 25 AS a, o_custkey % 24 AS b, 0.25e0 AS f FROM orders)
SELECT o_orderkey, CAST(t AS INTEGER) AS until_min, v AS value FROM s, LATERAL (VALUES
(CASE WHEN a IN (0, 24) OR a > b THEN b ELSE a END * 60, CASE WHEN a IN (0, 24) OR a > b THEN f ELSE 1e0 END),
(CASE WHEN a IN (0, 24) THEN 24 WHEN a > b THEN a ELSE b END * 60, CASE WHEN a IN (0, 24) OR a > b THEN 1e0 ELSE f END),
(CASE WHEN a NOT IN (0, 24) AND a > b THEN 1440 END, f)) x(t, v) WHERE t IS NOT NULL""",
)
def exterior_setback(spark, sf_dir):
    specs = inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 25).cast("double").alias("start"),
        (F.col("o_custkey") % 24).cast("double").alias("end"),
        F.lit(0.25).alias("fraction"),
    )
    return schedule.to_points(schedule.exterior_setback(specs), ("o_orderkey",))


LIMIT_NAMES = ["Fraction", "Thermostat Cooling Setpoint", "Temperature", "HVAC Operation", "Unknown"]


@query(
    "schedule_limits",
    f"""WITH {PROFILE_SQL},
l(type_name, lower, upper) AS (VALUES ('Fraction', 0e0, 1e0), ('Thermostat Cooling Setpoint', 0e0, 100e0), ('HVAC Operation', 0e0, 1e0)),
r AS (SELECT profile_id, {LIMIT_NAMES}[profile_id % 5 + 1] AS type_name, min(value) AS min_value, max(value) AS max_value FROM prof GROUP BY 1)
SELECT r.*, CASE WHEN r.type_name = 'Unknown' THEN 'unknown type'
WHEN min_value < lower OR max_value > upper THEN 'out of range' ELSE 'ok' END AS status
FROM r LEFT JOIN l USING (type_name)""",
)
def schedule_limits(spark, sf_dir):
    names = F.array(*(F.lit(n) for n in LIMIT_NAMES))
    typed = profiles(spark, sf_dir).withColumn("type_name", F.get(names, (F.col("profile_id") % 5).cast("int")))
    return schedule.check_limits(typed, schedule.type_limits(spark))


@query(
    "schedule_clones",
    """WITH u AS (SELECT l_suppkey AS model_id, CASE WHEN l_linenumber > 1 THEN l_returnflag || l_linenumber END AS cooling FROM lineitem)
SELECT model_id, cooling, cooling || ' adjusted by 4 F' AS new_cooling, count(*) AS n_users FROM u WHERE cooling IS NOT NULL GROUP BY 1, 2""",
)
def schedule_clones(spark, sf_dir):
    return schedule.clones(thermostats(spark, sf_dir), "cooling", F.lit(" adjusted by 4 F"))


def thermostats(spark, sf_dir):
    named = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    return inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model_id"),
        F.col("l_orderkey").alias("zone_id"),
        F.when(F.col("l_linenumber") > 1, named).alias("cooling"),
        (F.col("l_linestatus") == "O").alias("ideal_loads"),
    )


@query(
    "schedule_relinked",
    """SELECT l_suppkey AS model_id, l_orderkey AS zone_id,
coalesce(CASE WHEN l_linenumber > 1 THEN l_returnflag || l_linenumber END || ' adjusted by 4 F', 'none') AS new_cooling FROM lineitem""",
)
def schedule_relinked(spark, sf_dir):
    linked = schedule.relink_clones(thermostats(spark, sf_dir), "cooling", F.lit(" adjusted by 4 F"))
    return linked.select(
        "model_id", "zone_id", F.coalesce("new_cooling", F.lit("none")).alias("new_cooling")
    )


@query(
    "thermostats_without_schedule",
    """SELECT l_suppkey AS model_id, l_orderkey AS zone_id, count(*) AS n FROM lineitem
WHERE l_linenumber <= 1 OR (l_suppkey, l_returnflag || l_linenumber) NOT IN
  (SELECT (l_suppkey, l_returnflag || l_linenumber) FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus = 'O')
GROUP BY 1, 2""",
)
def thermostats_without_schedule(spark, sf_dir):
    schedules = (
        inputs.table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") != "A") & (F.col("l_linestatus") == "O"))
        .select(
            F.col("l_suppkey").alias("model_id"),
            F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("schedule_id"),
        ).distinct()
    )
    lost = schedule.without_schedule(thermostats(spark, sf_dir), schedules, "cooling")
    return lost.groupBy("model_id", "zone_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unconditioned_thermostats",
    """SELECT l_suppkey AS model_id, l_orderkey AS zone_id FROM lineitem l WHERE l_linestatus <> 'O' AND NOT EXISTS (
SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_custkey % 100 = l.l_suppkey % 100)""",
)
def unconditioned_thermostats(spark, sf_dir):
    equipment = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("zone_id"), (F.col("o_custkey") % 100).alias("model_id")
    )
    zones = thermostats(spark, sf_dir).withColumns(
        {"shown_model": F.col("model_id"), "model_id": F.col("model_id") % 100}
    )
    bare = schedule.unconditioned_thermostats(zones, equipment)
    return bare.select(F.col("shown_model").alias("model_id"), "zone_id")


WARP = (8.0, 17.5, 1.5, -2.0)

WARP_SQL = f"""
WITH {PROFILE_SQL},
k AS (SELECT 480e0 AS op, 1050e0 AS cl, 765e0 AS mo, 1485e0 AS mc, 11e0 / 9.5e0 AS ro, 13e0 / 14.5e0 AS rc, -120e0 AS sh),
r AS (SELECT profile_id, until_min AS m, value, CASE WHEN until_min < op THEN until_min + 1440 ELSE until_min END AS run FROM prof, k),
n AS (SELECT profile_id, m, value, m + sh + CASE WHEN run <= cl THEN (run - mo) * (ro - 1) ELSE (run - mc) * (rc - 1) END AS t FROM r, k),
w AS (SELECT profile_id, m, value, round(CASE WHEN t < 0 THEN t + 1440 WHEN t > 1440 THEN t - 1440 ELSE t END * 60) / 60 AS t FROM n),
d AS (SELECT profile_id, t, arg_max(value, m) AS value FROM w GROUP BY 1, 2),
e AS (SELECT profile_id, coalesce(max(value) FILTER (t = 1440), arg_min(value, t)) AS value FROM d GROUP BY 1),
p AS (SELECT profile_id, t, value FROM d WHERE t < 1440 UNION ALL SELECT profile_id, 1440e0, value FROM e),
a AS (SELECT profile_id, list({{'t': t, 'v': value}} ORDER BY t) AS l FROM p GROUP BY 1),
th AS (SELECT profile_id, list_reduce(list_transform(l, lambda x: [x]),
       lambda acc, x: CASE WHEN x[1].t - acc[-1].t > 1 THEN list_concat(acc, x) ELSE acc END) AS l FROM a),
u AS (SELECT profile_id, unnest(l) AS q FROM th)
SELECT profile_id, round(q.t, 4) AS until_min, q.v AS value FROM u WHERE profile_id % 4 = 0 OR (profile_id % 4 = 1 AND profile_id % 3 > 0)
UNION ALL SELECT profile_id, CAST(until_min AS DOUBLE), value FROM prof WHERE profile_id % 4 > 1 OR (profile_id % 4 = 1 AND profile_id % 3 = 0)"""


@query("operating_hours_warp", WARP_SQL)
def operating_hours_warp(spark, sf_dir):
    """Default profiles and rules of Mondays change; rules of Sundays and design days stay."""
    sunday = F.col("profile_id") % 3 == 0
    days = F.array(sunday, ~sunday, *(F.lit(False) for _ in range(5)))
    shaped = profiles(spark, sf_dir).withColumn("dow", F.when(F.col("kind") == "rule", days))
    monday = [day == 1 for day in range(7)]
    warped = schedule.change_hours_of_operation(shaped, *WARP, weekdays=monday).drop("dow")
    return schedule.to_points(warped).withColumn("until_min", F.round("until_min", 4))


@query(
    "profile_thinned",
    """WITH p AS (SELECT l_orderkey AS profile_id, CAST(floor(l_extendedprice / 100) AS INTEGER) AS until_min, max(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2),
a AS (SELECT profile_id, list({'t': until_min, 'v': value} ORDER BY until_min) AS l FROM p GROUP BY 1),
th AS (SELECT profile_id, list_reduce(list_transform(l, lambda x: [x]),
       lambda acc, x: CASE WHEN x[1].t - acc[-1].t > 45 THEN list_concat(acc, x) ELSE acc END) AS l FROM a),
u AS (SELECT profile_id, unnest(l) AS q FROM th)
SELECT profile_id, q.t AS until_min, q.v AS value FROM u""",
)
def profile_thinned(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("profile_id"),
        F.floor(F.col("l_extendedprice") / 100).cast("int").alias("until_min"),
        F.col("l_quantity").alias("value"),
    )
    shaped = schedule.to_profiles(rows)
    return schedule.to_points(schedule.edit(shaped, P.thin(F.col("points"), 45.0)))
