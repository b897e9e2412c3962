"""Shed metrics of scenarios against their baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.calendar import day_key
from demandloom.functions.units import celsius_to_fahrenheit, joules_to_kw
from demandloom.session import shuffle_width


def to_meter(raw: DataFrame, keys: Sequence[str] = ("run_id", "ts"), interval_s: int = 900) -> DataFrame:
    """Outdoor temperature in F and mean building kW of each interval.

    NaN becomes NULL so that later means skip it.
    """
    def clean(name: str) -> Column:
        return F.nanvl(F.col(name), F.lit(None).cast("double"))

    return raw.select(
        *keys,
        celsius_to_fahrenheit(clean("oat_c")).alias("oat_f"),
        joules_to_kw(clean("elec_j"), interval_s).alias("bldg_kw"),
    )


def bin_start(ts: str, minutes: int) -> Column:
    return F.window(ts, f"{minutes} minutes")["start"]


def with_each_scenario(baseline: DataFrame, link: DataFrame, time: str = "ts", spread: int | None = None) -> DataFrame:
    """A copy of the baseline rows (``baseline_id`` and ``time``) for each of its scenarios.

    One baseline may serve very many scenarios, and its copies must not come from
    one task: its times fall into ``spread`` groups (as many as the session has
    shuffle partitions), and ``link`` is repeated per group.
    """
    spread = spread or shuffle_width(baseline.sparkSession)
    group = F.pmod(F.xxhash64(time), F.lit(spread)).cast("int")
    links = link.select("run_id", "baseline_id", "floor_area")
    repeated = links.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    copies = baseline.withColumn("_spread", group).join(repeated.hint("merge"), ["baseline_id", "_spread"])
    return copies.drop("_spread")


def _as_baseline(baseline: DataFrame) -> DataFrame:
    return baseline.select(
        F.col("run_id").alias("baseline_id"), "ts", "oat_f", F.col("bldg_kw").alias("base_kw")
    )


def pair_with_baseline(baseline: DataFrame, scenario: DataFrame, link: DataFrame) -> DataFrame:
    """Put each scenario next to its baseline, keeping every baseline interval.

    ``link`` has one row per scenario: ``run_id, baseline_id, floor_area``. The
    result holds a copy of the baseline per scenario; for means over bins use
    :func:`binned_shed`, which copies none. The second join is on (run, time),
    which no single run or baseline can dominate.
    """
    loads = scenario.select("run_id", "ts", F.col("bldg_kw").alias("scenario_kw"))
    return with_each_scenario(_as_baseline(baseline), link).join(loads, ["run_id", "ts"], "left")


# Stored baselines and scenarios lie in buckets of these.
PAIR_KEYS = ("baseline_id", "ts")


def pair_stored(baseline: DataFrame, scenario: DataFrame, link: DataFrame) -> DataFrame:
    """What :func:`pair_with_baseline` gives, from tables in buckets of ``PAIR_KEYS``, without moving their rows.

    ``baseline`` has ``n_runs``, the number of scenarios of its baseline, and ``scenario`` its
    ``baseline_id`` and ``floor_area``. Rows meet within their bucket, and scenarios are counted there. Only
    baseline intervals with fewer than all scenarios are looked at again, and only these go to the list of scenarios.
    """
    keys = list(PAIR_KEYS)
    met = baseline.drop("n_runs").join(scenario.hint("merge"), keys)
    there = scenario.select(*keys, "run_id").distinct()
    counted = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lacking = baseline.join(counted.hint("merge"), keys, "left").where(F.coalesce("_n", F.lit(0)) < F.col("n_runs")).drop("_n", "n_runs")
    found = there.join(lacking.select(*keys).distinct().hint("merge"), keys, "left_semi").groupBy(*keys).agg(F.collect_list("run_id").alias("_there"))
    # A list holds the scenarios of one baseline.
    lists = link.groupBy("baseline_id").agg(F.collect_set("run_id").alias("_all"))
    none = F.array().cast("array<string>")
    absent = F.explode(F.array_except("_all", F.coalesce("_there", none)))
    missing = (
        lacking.join(found.hint("merge"), keys, "left").join(lists, "baseline_id")
        .select(*keys, "oat_f", "base_kw", absent.alias("run_id"))
        .join(link.select("run_id", "floor_area"), "run_id")
        .withColumn("scenario_kw", F.lit(None).cast("double"))
    )
    return met.unionByName(missing)


def binned_shed(baseline: DataFrame, scenario: DataFrame, link: DataFrame, step_minutes: int = 60) -> DataFrame:
    """Means per run and time bin of what :func:`pair_with_baseline` and :func:`add_shed` give.

    The intervals of a baseline within a bin are gathered (as many as a bin has
    intervals) and scenario rows look their own time up there. They are placed by
    (baseline, bin) for that and averaged where they are. Only the baseline's
    means, a row per bin, are copied per scenario, for the bins without scenario rows.
    """
    base = _as_baseline(baseline).withColumn("bin", bin_start("ts", step_minutes))
    bins = base.groupBy("baseline_id", "bin").agg(
        F.collect_list(F.struct("ts", "base_kw")).alias("_intervals"),
        F.avg("oat_f").alias("oat_f"), F.avg("base_kw").alias("base_kw"),
    )
    loads = scenario.select("run_id", "ts", F.col("bldg_kw").alias("scenario_kw")).join(
        link.select("run_id", "baseline_id", "floor_area"), "run_id"
    )
    intervals = F.filter("_intervals", lambda interval: interval["ts"] == F.col("ts"))
    met = (
        loads.withColumn("bin", bin_start("ts", step_minutes))
        .join(bins.select("baseline_id", "bin", "_intervals").hint("merge"), ["baseline_id", "bin"])
        .select("run_id", "baseline_id", "bin", "floor_area", "scenario_kw", F.inline(intervals))
    )
    means = add_shed(met).groupBy("baseline_id", "bin", "run_id").agg(
        *(F.avg(c).alias(c) for c in ("scenario_kw", "shed_pct", "shed_w_ft2"))
    )
    kept = with_each_scenario(bins.drop("_intervals"), link, "bin").drop("floor_area")
    return kept.join(means.hint("merge"), ["baseline_id", "bin", "run_id"], "left").select(
        "run_id", F.col("bin").alias("ts"), "oat_f", "base_kw", "scenario_kw", "shed_pct", "shed_w_ft2"
    )


def add_shed(paired: DataFrame) -> DataFrame:
    """Shed fraction of the baseline and shed density in W/ft2."""
    saved = F.col("base_kw") - F.col("scenario_kw")
    return paired.withColumns(
        {
            "shed_pct": F.try_divide(saved, F.col("base_kw")),
            "shed_w_ft2": F.try_divide(saved * 1000.0, F.col("floor_area")),
        }
    )


def resample_mean(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("run_id",),
    ts: str = "ts",
    step_minutes: int = 60,
    densify: bool = False,
) -> DataFrame:
    """Mean per time bin; with ``densify`` empty bins between the first and the
    last of a run appear as rows of NULLs."""
    width = f"{step_minutes} minutes"
    binned = (
        df.groupBy(*keys, F.window(ts, width).alias("_bin"))
        .agg(*(F.avg(c).alias(c) for c in columns))
        .select(*keys, F.col("_bin.start").alias(ts), *columns)
    )
    if not densify:
        return binned
    span = (
        binned.groupBy(*keys)
        .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
        .select(
            *keys,
            F.explode(
                F.sequence("_first", "_last", F.expr(f"INTERVAL {step_minutes} MINUTES"))
            ).alias(ts),
        )
    )
    # Sizes are not known for unfolded rows, so neither side is offered for broadcast.
    return span.join(binned.hint("merge"), [*keys, ts], "left")


def peak_shed(df: DataFrame, keys: Sequence[str] = ("run_id",), value: str = "shed_w_ft2") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias("peak_" + value))


def day_hour_cells(
    hourly: DataFrame,
    value: str = "shed_w_ft2",
    keys: Sequence[str] = ("run_id",),
    ts: str = "ts",
    day: str = "calendar_day",
) -> DataFrame:
    """Long form of the day x hour table: one mean per run, day and hour.

    An hour of a calendar day is one row of ``hourly`` already, so only day keys
    that fold several days together need an aggregation.
    """
    cells = hourly.where(F.col(value).isNotNull()).select(
        *keys, day_key(F.col(ts), day).alias("day"), F.hour(ts).alias("hour"), value
    )
    if day == "calendar_day":
        return cells
    return cells.groupBy(*keys, "day", "hour").agg(F.avg(value).alias(value))


def day_hour_pivot(
    hourly: DataFrame,
    value: str = "shed_w_ft2",
    keys: Sequence[str] = ("run_id",),
    ts: str = "ts",
    day: str = "calendar_day",
) -> DataFrame:
    """Day x hour table with columns ``h00`` .. ``h23``, in one aggregation."""
    hour = F.hour(ts)
    return (
        hourly.where(F.col(value).isNotNull())
        .groupBy(*keys, day_key(F.col(ts), day).alias("day"))
        .agg(*(F.avg(F.when(hour == h, F.col(value))).alias(f"h{h:02d}") for h in range(24)))
    )


def _with_fences(cells: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    # A (run, hour) group holds one cell per day, so its size is set by the calendar.
    group = Window.partitionBy(*keys, "hour")
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(group)
    spread = 1.5 * (F.col("_q")[2] - F.col("_q")[0])
    return (
        cells.withColumn("_q", quartiles)
        .withColumns({"_low": F.col("_q")[0] - spread, "_high": F.col("_q")[2] + spread})
    )


def box_stats(
    cells: DataFrame, value: str = "shed_w_ft2", keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Box-plot numbers per hour: quartiles, whiskers and how many lie beyond."""
    v = F.col(value)
    inside = v.between(F.col("_low"), F.col("_high"))
    q1, q3 = F.first(F.col("_q")[0]), F.first(F.col("_q")[2])
    return (
        _with_fences(cells, value, keys)
        .groupBy(*keys, "hour")
        .agg(
            F.count(v).alias("n_days"),
            F.avg(v).alias("mean"),
            q1.alias("q1"),
            F.first(F.col("_q")[1]).alias("median"),
            q3.alias("q3"),
            F.least(F.min(F.when(inside, v)), q1).alias("whisker_low"),
            F.greatest(F.max(F.when(inside, v)), q3).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def box_outliers(
    cells: DataFrame, value: str = "shed_w_ft2", keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """The cells beyond the whiskers, one row each."""
    fenced = _with_fences(cells, value, keys)
    return fenced.where(~F.col(value).between(F.col("_low"), F.col("_high"))).select(
        *keys, "day", "hour", value
    )


def mean_profile(
    cells: DataFrame, value: str = "shed_w_ft2", keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Mean over days per hour."""
    return cells.groupBy(*keys, "hour").agg(
        F.avg(value).alias("mean_" + value), F.count(value).alias("n_days")
    )


def segment_of(oat: Column, breakpoint: float) -> Column:
    return F.when(oat <= breakpoint, "low").when(oat > breakpoint, "high")


def piecewise_fit(
    hourly: DataFrame,
    y: str = "shed_w_ft2",
    x: str = "oat_f",
    keys: Sequence[str] = ("run_id",),
    ts: str = "ts",
    breakpoint: float = 75.0,
) -> DataFrame:
    """Straight line through each side of a temperature break, for all hours at once.

    ``panel_hour`` is the label used for the hour in the published panels, one
    later than the hour of the data. A segment with one point has no slope.
    """
    return (
        hourly.where(F.col(y).isNotNull() & F.col(x).isNotNull())
        .groupBy(*keys, F.hour(ts).alias("hour"), segment_of(F.col(x), breakpoint).alias("segment"))
        .agg(
            F.count(y).alias("n"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"),
            F.min(x).alias("x_min"),
            F.max(x).alias("x_max"),
        )
        .withColumn("panel_hour", F.col("hour") + 1)
    )


def fit_line(fit: DataFrame, breakpoint: float = 75.0, samples: int = 100) -> DataFrame:
    """Evenly spaced points on each fitted line, up to the break from either side."""
    low = F.col("segment") == "low"
    start = F.when(low, F.col("x_min")).otherwise(F.lit(breakpoint))
    stop = F.when(low, F.lit(breakpoint)).otherwise(F.col("x_max"))
    step = F.col("sample_no") / F.lit(float(samples - 1))
    return (
        fit.where(F.col("slope").isNotNull())
        .withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("x", start + (stop - start) * step)
        .withColumn("y", F.col("slope") * F.col("x") + F.col("intercept"))
    )
