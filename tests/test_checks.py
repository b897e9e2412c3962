"""Argument checks, requests and logs."""

import pytest

from demandloom.operators import logs, requests, validate
from pyspark.sql import functions as F


def status(df):
    row = df.first()
    return row.status, len(row.messages)


@pytest.mark.parametrize(
    "cooling,heating,expected",
    [
        (4.0, -2.0, ("ok", 0)),
        (-2.0, 0.0, ("warning", 1)),
        (-600.0, 0.0, ("warning", 1)),  # a lower setpoint is never range-checked
        (600.0, 0.0, ("error", 1)),
        (60.0, 1.0, ("warning", 2)),
        (0.0, -501.0, ("error", 1)),
    ],
)
def test_setpoint_deltas(spark, cooling, heating, expected):
    df = spark.createDataFrame([(cooling, heating)], "cooling double, heating double")
    assert status(validate.check_setpoint_deltas(df)) == expected


@pytest.mark.parametrize(
    "window,good,compat_good",
    [
        ((12, 0, 18, 0), "ok", "ok"),
        ((12, 30, 18, 0), "ok", "error"),
        ((18, 0, 12, 0), "error", "error"),
        ((24, 0, 24, 0), "error", "error"),
        ((0, 60, 1, 60), "error", "error"),
    ],
)
def test_event_window(spark, window, good, compat_good):
    df = spark.createDataFrame([window], "start_hour int, start_minute int, end_hour int, end_minute int")
    assert status(validate.check_event_window(df))[0] == good
    assert status(validate.check_event_window(df, compat=True))[0] == compat_good


PERCENTS = ["occupied", "unoccupied", "single"]


@pytest.mark.parametrize(
    "row,expected",
    [
        ((30.0, 95.0, 30.0, 780, 900), ("warning", 1)),
        ((120.0, 95.0, 30.0, 780, 900), ("error", 2)),
        ((30.0, 30.0, 30.0, 780, 600), ("error", 1)),
        ((0.0, 0.5, -10.0, 780, 900), ("warning", 3)),
        ((0.0, 30.0, -10.0, 780, 900), ("ok", 2)),
    ],
)
def test_lighting(spark, row, expected):
    df = spark.createDataFrame(
        [row], "occupied double, unoccupied double, single double, start_min int, end_min int"
    )
    assert status(validate.check_lighting(df, PERCENTS)) == expected


@pytest.mark.parametrize(
    "row,expected",
    [((45.0, 2, 10.0), "ok"), ((-101.0, 2, 10.0), "error"), ((45.0, 0, None), "not_applicable"), ((45.0, 2, None), "not_applicable")],
)
def test_insulation(spark, row, expected):
    df = spark.createDataFrame([row], "percent double, n_surfaces int, area double")
    assert status(validate.check_insulation(df))[0] == expected


@pytest.mark.parametrize(
    "value,inclusive,expected", [("0", True, "ok"), ("0", False, "error"), (None, True, "ok"), ("11", True, "error")]
)
def test_ranges(spark, value, inclusive, expected):
    arguments = spark.createDataFrame([("p", value)], "param string, value string")
    rules = spark.createDataFrame(
        [("p", 0.0, 10.0, inclusive, inclusive, 5.0)],
        "param string, low double, high double, low_inclusive boolean, high_inclusive boolean, default_value double",
    )
    assert status(validate.check_ranges(arguments, rules))[0] == expected


def test_choices(spark, rows):
    arguments = spark.createDataFrame(
        [("template", "90.1-2010"), ("template", "90.1-1999"), ("reporting_frequency", "timestep")],
        "param string, value string",
    )
    assert rows(validate.not_a_choice(arguments, validate.choice_table(spark))) == [("template", "90.1-1999")]


def test_blank_key_becomes_a_star(spark):
    df = spark.createDataFrame(
        [("", "Site Wind Speed", "hourly")], "key string, variable_name string, reporting_frequency string"
    )
    row = validate.clean_output_requests(df).first()
    assert (row.key, row.status) == ("*", "ok")
    bad = df.withColumn("variable_name", F.lit(" "))
    assert validate.clean_output_requests(bad).first().status == "error"


def test_chosen_objects(spark):
    chosen = spark.createDataFrame(
        [("m", "a"), ("m", ""), ("m", "gone"), ("m", "whole")], "model_id string, handle string"
    )
    objects = spark.createDataFrame([("m", "a")], "model_id string, handle string")
    got = {r.handle: (r.status, r.apply_to_building) for r in validate.resolve_choices(chosen, objects, building="whole").collect()}
    assert got == {"a": ("ok", False), "": ("error", False), "gone": ("error", False), "whole": ("ok", True)}


@pytest.mark.parametrize("delta,expected", [(2.0, "ok"), (14.5, "error"), (-10.5, "error")])
def test_hours_of_operation(spark, delta, expected):
    df = spark.createDataFrame([(8.0, 18.0, delta)], "start double, finish double, delta_length double")
    assert status(validate.check_hours_of_operation(df))[0] == expected


def test_typed_arguments(spark):
    df = spark.createDataFrame([("6", None), ("x", "1.1")], "timestep string, factor string")
    typed = validate.typed_arguments(df, {"timestep": ("int", 4), "factor": ("double", 1.2)})
    assert [(r.timestep, r.factor, r.status) for r in typed.collect()] == [(6, 1.2, "ok"), (None, 1.1, "error")]


def test_change_report(spark, rows):
    old = spark.createDataFrame([("m", 6, 1.2)], "model_id string, timestep int, factor double")
    new = old.withColumn("timestep", F.lit(4))
    assert rows(validate.change_report(old, new, ["timestep", "factor"])) == [
        ("m", "factor", "1.2", "1.2"), ("m", "timestep", "6", "4")
    ]


def test_meter_upsert(spark, rows):
    schema = "model_id string, name string, reporting_frequency string"
    existing = spark.createDataFrame([("m", "Fans", "hourly"), ("m", "Gas", "daily"), ("m", "Heat", "daily"), ("m", "Pumps", None), ("m", "Rest", None)], schema)
    wanted = spark.createDataFrame([("m", "Fans", "timestep"), ("m", "New", "hourly"), ("m", "Heat", "daily"), ("m", "Pumps", "daily")], schema)
    assert rows(requests.upsert_meters(existing, wanted), "name", "reporting_frequency", "action") == [
        ("Fans", "timestep", "changed"), ("Gas", "daily", "kept"), ("Heat", "daily", "kept"), ("New", "hourly", "added"),
        ("Pumps", "daily", "changed"), ("Rest", None, "kept"),
    ]


def test_unknown_reporting_schedule_is_dropped(spark):
    asked = spark.createDataFrame(
        [("m", None), ("m", "known"), ("m", "lost"), ("m", requests.THREE_DAYS_PER_MONTH)],
        "model_id string, reporting_schedule string",
    )
    known = spark.createDataFrame([("m", "known"), ("other", "lost")], "model_id string, name string")
    row = requests.request_counts(requests.match_reporting_schedule(asked, known)).first()
    assert (row.n_requested, row.n_added) == (4, 3)


def test_log_messages(spark, rows):
    log = spark.createDataFrame(
        [
            ("r", "app.model", "Warn", "bad area"), ("r", "app.model", "Info", "Skipping layer 2"),
            ("r", "app.runmanager", "Error", "lost"), ("r", "other", "Error", "not ours"),
            ("r", "app.x", "Error", "failed"), ("r", "app.x", "Debug", "detail"), ("r", "app.x", "Info", "done"),
        ],
        "run_id string, channel string, level string, message string",
    )
    kept = logs.relevant(log, "^app")
    assert rows(logs.classify(kept), "shown_as", "text") == [
        ("error", "[app.x] failed"), ("info", "done"), ("warning", "[app.model] bad area")
    ]
    assert logs.classify(kept, debug=True).where("text = 'DEBUG - detail'").count() == 1
    assert rows(logs.count_levels(logs.classify(kept))) == [("r", "error", 1), ("r", "info", 1), ("r", "warning", 1)]
