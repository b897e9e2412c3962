"""Grids, codes, lookups and workflow documents."""

import json

import pytest

from demandloom import constants as K
from demandloom.operators import design, workflow
from demandloom.schemas import BASE_MODEL_NAMES, EVENT_NAMES
from demandloom.sources import readers, writers
from pyspark.sql import functions as F

BASE_MODELS = (
    "BaseModelId,BldgType,BldgVint,BldgLoc,TimeStep\r"
    "MediumOffice_Post1980_3B,MediumOffice,DOE Ref 1980-2004,ASHRAE 169-2006-3B,4\r"
    "MediumOffice_2010_3B,MediumOffice,90.1-2010,ASHRAE 169-2006-3B,4"
)
EVENTS = (
    "measureId,base_tstat,start_hour,end_hour,precool_hours,precool_deg,reset_deg\r"
    "74_12_18_6_2_4,74,12,18,6,2,4"
)


@pytest.fixture
def one_model(spark):
    return spark.createDataFrame([("m",)], "model_id string")


@pytest.fixture
def tables(spark, tmp_path):
    (tmp_path / "models.csv").write_text(BASE_MODELS)
    (tmp_path / "events.csv").write_text(EVENTS)
    return (
        readers.read_params(spark, str(tmp_path / "models.csv"), BASE_MODEL_NAMES),
        readers.read_params(spark, str(tmp_path / "events.csv"), EVENT_NAMES),
    )


def test_grid_has_the_published_size_and_unique_ids(one_model):
    grid = design.event_grid(one_model)
    assert grid.count() == 6318
    assert grid.select("case_id").distinct().count() == 6318


def test_compat_ids_repeat(one_model):
    grid = design.event_grid(one_model, compat=True)
    assert grid.count() == 6318
    assert grid.select("case_id").distinct().count() == 2106
    assert grid.first().case_id.startswith("DF_70_6_2_[2, 4, 6]_")


def test_grid_keeps_the_constraints(one_model):
    bad = design.event_grid(one_model).where(
        "event_start + event_hours > 22 or hvac_tstat - precool_deg < 70 or hvac_tstat + reset_deg > 80"
    )
    assert bad.count() == 0


def test_model_grid_has_125_models(spark):
    def column(values, name):
        return spark.createDataFrame([(v,) for v in values], f"{name} string")

    grid = design.model_grid(
        column(K.BLDG_TYPES, "bldg_type"), column(K.BLDG_VINTAGES, "bldg_vintage"), column(K.CLIMATES, "climate")
    )
    assert grid.count() == 125
    assert grid.where("model_id = 'model_SmallOffice_pre1980_2A'").count() == 1


def test_codes(one_model):
    coded = design.encode(design.event_grid(one_model))
    assert {(r.hvac_tstat, r.hvac_tstat_code) for r in coded.collect()} == {(70 + i, i + 1) for i in range(7)}
    assert {(r.precool_hours, r.precool_hours_code) for r in coded.collect()} == {(2, None), (4, 6), (6, 11)}


def test_baseline_of_each_case(one_model):
    cases = design.event_grid(one_model)
    matched = design.match_baseline(cases)
    assert matched.count() == 6318 and matched.where("baseline_id is null").count() == 0
    row = matched.where("case_id = 'DF_74_12_6_2_2_4'").first()
    assert row.baseline_id == "DF_74_12_6_2_0_0"


def test_lookup_keeps_column_order_and_reports_missing(spark, rows):
    table = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "case_no int, second string, first string")
    lookup = spark.createDataFrame([("second", "m2")], "param string, measure string")
    long = design.design_long(table)
    assert rows(long, "case_no", "param_pos", "param", "value")[0] == (1, 0, "second", "a")
    assert {(r.param, r.measure, r.error) for r in design.join_lookup(long, lookup).collect()} == {
        ("second", "m2", None), ("first", None, "no description for first")
    }
    assert rows(design.missing_params(long, lookup)) == [("first", 2)]


def test_header_is_replaced_and_bare_cr_lines_are_read(tables):
    models, events = tables
    assert models.columns == BASE_MODEL_NAMES and events.columns == EVENT_NAMES
    assert [r.BaseModelId for r in models.collect()] == ["MediumOffice_Post1980_3B", "MediumOffice_2010_3B"]


def test_params_json_round_trip(spark, tables, tmp_path, rows):
    models, _ = tables
    writers.write_params_json(models, str(tmp_path / "json"))
    back = spark.read.schema(models.schema).json(str(tmp_path / "json"))
    assert rows(back) == rows(models)
    (tmp_path / "array.json").write_text(json.dumps([r.asDict() for r in models.collect()]))
    read = readers.read_params_json(spark, str(tmp_path / "array.json"), BASE_MODEL_NAMES)
    assert rows(read.drop("file", "status")) == rows(models)
    (tmp_path / "array.json").write_text("[{")
    assert [r.status for r in readers.read_params_json(spark, str(tmp_path / "array.json"), BASE_MODEL_NAMES).collect()] == ["unreadable"]


SETPOINT = "ChangeHeatingAndCoolingSetpoint"
EXPECTED_STEPS = [
    ("CreateDOEPrototypeBuilding",
     {"building_type": "MediumOffice", "template": "90.1-2010", "climate_zone": "ASHRAE 169-2006-3B"}),
    ("SetTimestep", {"timestep": "4"}),
    (SETPOINT, {"cooling_adjustment": -2, "heating_adjustment": 0, "start_hour": 6, "end_hour": "12"}),
    (SETPOINT, {"cooling_adjustment": "4", "heating_adjustment": 0, "start_hour": "12", "end_hour": "18"}),
]


def test_documents_equal_the_published_one(spark, tables, tmp_path):
    cases = workflow.event_cases(*tables)
    docs = workflow.documents(cases, ["."], ["measures"])
    got = {r.case_id: json.loads(r.document) for r in docs.collect()}
    assert set(got) == {"MediumOffice_Post1980_3B_74_12_18_6_2_4", "MediumOffice_2010_3B_74_12_18_6_2_4"}
    document = got["MediumOffice_2010_3B_74_12_18_6_2_4"]
    assert document["seed_file"] is None and document["weather_file"] is None
    assert [(s["measure_dir_name"], s["arguments"]) for s in document["steps"]] == EXPECTED_STEPS
    writers.write_documents(docs, str(tmp_path / "docs"))
    back = readers.read_documents(spark, str(tmp_path / "docs"))
    assert {r.case_id: json.loads(r.document) for r in back.collect()} == got
    assert all(p.name.startswith("bucket=") for p in (tmp_path / "docs").iterdir() if p.is_dir())
    writers.write_documents(docs, str(tmp_path / "folders"), folder_per_case=True)
    back = spark.read.text(str(tmp_path / "folders"))
    assert {r.case_id: json.loads(r.value) for r in back.collect()} == got


def test_running_steps_pile_up(spark, tables):
    models, event = tables
    events = event.withColumn("event_pos", F.lit(0)).unionByName(
        event.withColumn("event_pos", F.lit(1)).withColumn("MeasureId", F.lit("second"))
    )
    cases = workflow.event_cases(models, events)
    apart = {r.n for r in cases.select(F.size("steps").alias("n")).collect()}
    piled = sorted((r.n_steps, r.last_step_pos) for r in workflow.running_event_steps(cases).collect())
    assert apart == {4} and piled == [(4, 3), (4, 3), (6, 5), (6, 5)]


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_running_steps_of_uneven_cases(spark, block):
    """Any number of event steps, ties, cases without position or without event steps, in blocks of any size."""
    sizes = {"m": [(0, 3), (1, 0), (1, 2), (4, 1), (9, 5), (None, 2), (-3, 1)], "n": [(7, 4)]}
    rows = [
        (model, f"{model}{i}", pos, [("p", i), ("t", i), *((f"e{j}", i) for j in range(own))])
        for model, events in sizes.items() for i, (pos, own) in enumerate(events)
    ]
    kind = "BaseModelId string, case_id string, event_pos long, steps array<struct<measure_dir_name:string,n:int>>"
    cases = spark.createDataFrame(rows, kind)
    got = {r.case_id: (r.n_steps, r.last_step_pos) for r in workflow.running_event_steps(cases, block_events=block).collect()}
    want, pile = {}, {}
    for model in sizes:
        steps = []
        own = [row for row in rows if row[0] == model]
        for _, case, _, mine in sorted(own, key=lambda row: (row[2] is not None, row[2] or 0, row[1])):
            steps += [(case, *step) for step in mine[2:]]
            want[case] = (2 + len(steps), 1 + len(steps))
            pile[case] = [(case, *step) for step in mine[:2]] + list(steps)
    assert got == want
    found = {}
    for r in workflow.piled_up_steps(cases, block_events=block).orderBy("step_pos").collect():
        found.setdefault(r.case_id, []).append((r.step_pos, r.from_case, *r.step))
    assert found == {case: [(i, *step) for i, step in enumerate(steps)] for case, steps in pile.items()}


def test_running_steps_split_a_model_over_tasks(spark):
    rows = [("m", f"c{i:05}", i, [0, 0, 1]) for i in range(4000)]
    cases = spark.createDataFrame(rows, "BaseModelId string, case_id string, event_pos long, steps array<int>")
    keys = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in zip(keys, ("false", "-1")):
            spark.conf.set(key, value)
        counted = workflow.running_event_steps(cases, block_events=100).withColumn("task", F.spark_partition_id())
        per_task = [r["count"] for r in counted.groupBy("task").count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(per_task) > 2 and max(per_task) < 3000 and sum(per_task) == 4000


TEXT_STEP = "struct<measure_dir_name:string,arguments:map<string,string>>"


def test_rows_without_a_known_kind_have_no_step_and_say_so(spark):
    rows = spark.createDataFrame(
        [("a", "wall_r", "45", None), ("b", "roof", "1", None), ("c", None, "1", "no description for c")],
        "param string, measure string, value string, error string",
    )
    built = workflow.dispatch_steps(rows, {"wall_r": workflow.STEP_KINDS["wall_r"]("value")})
    got = {r.param: (r.body, r.error) for r in built.select("param", F.to_json("step").alias("body"), "error").collect()}
    assert json.loads(got["a"][0]) == {"measure_dir_name": "IncreaseWallRValue", "arguments": {"r_value": "45"}}
    assert (got["a"][1], got["b"][1], got["c"][1]) == (None, "no step of kind roof", "no description for c")


def test_each_step_kind_builds(spark):
    row = spark.createDataFrame(
        [("t", "v", "c", "4", "45", "4", "12", "18", "2", "6", "Electricity:Facility", "hourly", "meter")],
        "bldg_type string, bldg_vintage string, climate_zone string, time_step string, WallRValue string, "
        "reset_deg string, start_hour string, end_hour string, precool_deg string, precool_hours string, "
        "variable_name string, reporting_frequency string, report string",
    )
    built = row.select(
        *(F.from_json(F.to_json(make()), TEXT_STEP).alias(kind) for kind, make in workflow.STEP_KINDS.items())
    )
    step = built.first()
    assert step.wall_r.arguments == {"r_value": "45"}
    assert step.precool.arguments["cooling_adjustment"] == "-2" and step.precool.arguments["start_hour"] == "6"
    assert step.output_meter.arguments == {"meter_name": "Electricity:Facility", "reporting_frequency": "hourly"}
    assert row.select(workflow.output_step().alias("s")).first().s.measure_dir_name == "AddOutputMeter"


def test_assembled_steps_keep_source_and_position(spark):
    def steps(*pairs):
        df = spark.createDataFrame(list(pairs), "case_id string, pos int, name string")
        return df.select("case_id", "pos", workflow.step("x", name=F.col("name")).alias("step"))

    whole = workflow.append_steps([steps(("a", 1, "second"), ("a", 0, "first")), steps(("a", 0, "last"))])
    built = workflow.assemble_steps(whole).first()
    assert [s.arguments["name"].toPython() for s in built.steps] == ["first", "second", "last"]


def test_seed_ids_per_model(spark, tmp_path):
    def proto(kind, template):
        return {
            "measure_dir_name": "CreateDOEPrototypeBuilding",
            "arguments": {"building_type": kind, "template": template, "climate_zone": "ASHRAE 169-2006-3B"},
        }

    wall = {"measure_dir_name": "IncreaseWallRValue", "arguments": {"r_value": 45}}
    path = tmp_path / "list.json"
    path.write_text(json.dumps([[proto("MediumOffice", "DOE Ref 1980-2004"), wall], [proto("LargeOffice", "90.1-2010")]]))
    (tmp_path / "other.json").write_text(json.dumps([[proto("SmallOffice", "90.1-2010")]]))
    steps = readers.read_model_list(spark, str(tmp_path / "*.json"))
    got = sorted((r.model_no, r.seed_id, r.n_steps) for r in workflow.seed_models(steps).collect())
    assert got == [
        (0, "MediumOffice-1980-2004-3B", 2), (0, "SmallOffice-90.1-2010-3B", 1), (1, "LargeOffice-90.1-2010-3B", 1)
    ]
