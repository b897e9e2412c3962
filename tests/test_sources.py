"""Readers and writers on small files."""

import json

import pytest

from demandloom.operators import collection, requests
from demandloom.plans.metric_queries import REPORT_SPEC
from demandloom.sources import readers, writers
from pyspark.sql import functions as F


def test_meter_time_comes_from_the_step_number(spark, tmp_path):
    (tmp_path / "m.csv").write_text("run_id,step_no,oat_c,elec_j\na,35039,1.5,2\na,0,1,3\n")
    got = {r.step_no: str(r.ts) for r in readers.read_meter(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {0: "2017-01-01 00:00:00", 35039: "2017-12-31 23:45:00"}


def wide(spark):
    return spark.createDataFrame(
        [("2010", 0, 1.0, 2.0), ("2010", 1, 3.0, 4.0), ("base a", 0, 5.0, 6.0)],
        "run_id string, step_no int, oat_c double, elec_j double",
    ).withColumn("ts", F.timestamp_add("MINUTE", F.col("step_no") * 15, F.lit("2017-01-01").cast("timestamp_ntz")))


def test_runs_in_folders(spark, tmp_path, rows):
    path = str(tmp_path / "runs")
    titled = writers.with_published_headers(wide(spark))
    writers.write_wide(titled, path, order="ts", folder_per_run=True, parts_per_run=2)
    writers.write_wide(titled, path + "-buckets", order="ts", buckets=3)
    for back in (readers.read_runs(spark, path), readers.read_runs(spark, path + "-buckets", layout="buckets")):
        assert rows(back, "run_id", "oat_c", "elec_j") == rows(wide(spark), "run_id", "oat_c", "elec_j")
        assert dict(back.dtypes)["run_id"] == "string"
    writers.write_wide(titled.select("run_id", "ts", readers.ELEC_HEADER, readers.OAT_HEADER), path, order="ts", folder_per_run=True)
    with pytest.raises(Exception, match="header|Header"):
        readers.read_runs(spark, path).collect()


def test_runs_as_single_files(spark, tmp_path, rows):
    header = f",{readers.OAT_HEADER},{readers.ELEC_HEADER}\n"
    (tmp_path / "run one.csv").write_text(header + "2017-01-01 00:00:00,1.0,2.0\n")
    (tmp_path / "run2.csv").write_text(header + "2017-01-01 00:00:00,3.0,4.0\n")
    back = readers.read_runs(spark, str(tmp_path), layout="files")
    assert rows(back, "run_id", "oat_c") == [("run one", 1.0), ("run2", 3.0)]


def test_published_files_are_read_by_header(spark, tmp_path):
    swapped = f'"{readers.ELEC_HEADER}",Gas [J],{readers.OAT_HEADER}\r\n900000,7,20\r\n800000,7,\r\n'
    (tmp_path / "two words.csv").write_bytes(swapped.encode())
    got = sorted(map(tuple, readers.read_runs(spark, str(tmp_path), layout="files").collect()), key=lambda r: r[1])
    assert [(r[0], str(r[1]), *r[2:]) for r in got] == [
        ("two words", "2017-01-01 00:00:00", 20.0, 900000.0), ("two words", "2017-01-01 00:15:00", None, 800000.0)
    ]
    (tmp_path / "bad.csv").write_text(f",{readers.OAT_HEADER}\n2017-01-01 00:00:00,1\n")
    with pytest.raises(Exception, match="no column"):
        readers.read_runs(spark, str(tmp_path), layout="files").collect()


def test_stored_meter_reads_only_the_months_asked_for(spark, tmp_path, rows):
    from demandloom.functions.calendar import select_workdays

    ts = F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2017-01-01").cast("timestamp_ntz"))
    meter = spark.range(8760).select(
        F.lit("2010").alias("run_id"), ts.alias("ts"), F.lit(60.0).alias("oat_f"), F.col("id").cast("double").alias("bldg_kw")
    )
    writers.write_meter(meter, str(tmp_path / "meter"))
    stored = readers.read_stored_meter(spark, str(tmp_path / "meter"))
    picked = select_workdays(stored, (6, 7))
    assert picked.count() == select_workdays(meter, (6, 7)).count() == 43 * 24
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert rows(picked.select("run_id").distinct()) == [("2010",)]


def report(spark):
    zone, step = "Environment", "Zone Timestep"
    return spark.createDataFrame(
        [
            ("r", 0, zone, "Site Outdoor Air Drybulb Temperature", step, 10.0),
            ("r", 0, zone, "Site Outdoor Air Drybulb Temperature", "Hourly", 99.0),
            ("r", 0, "x", "Electricity:Facility", step, 5.0),
            ("r", 1, zone, "Site Outdoor Air Drybulb Temperature", step, 11.0),
            ("r", 1, zone, "Site Wind Speed", step, 3.0),
        ],
        "run_id string, step_no bigint, key_value string, name string, reporting_frequency string, value double",
    )


def test_report_filter_reaches_the_scan(spark, tmp_path, rows):
    path = str(tmp_path / "report")
    report(spark).write.parquet(path)
    wide_rows = collection.report_to_wide(readers.read_report(spark, path))
    assert rows(wide_rows) == [("r", 0, 10.0, 5.0), ("r", 1, 11.0, None)]
    plan = wide_rows._jdf.queryExecution().executedPlan().toString()
    assert "In(name" in plan.split("PushedFilters")[1]


def test_whole_report_without_a_spec(spark, tmp_path):
    path = str(tmp_path / "report")
    report(spark).write.parquet(path)
    assert readers.read_report(spark, path, None).count() == 5
    assert set(REPORT_SPEC) == {"oat_c", "elec_j"}


def test_design_and_lookup(spark, tmp_path):
    (tmp_path / "design.csv").write_text("r_value,infiltration\n10,0.1\n20,0.2\n")
    (tmp_path / "lookup.csv").write_text("name,measure\nr_value,IncreaseWallRValue\n")
    assert readers.read_design(spark, str(tmp_path / "design.csv")).columns == ["r_value", "infiltration"]
    assert readers.read_lookup(spark, str(tmp_path / "lookup.csv")).columns == ["param", "measure"]


def test_models_and_grid_files(spark, tmp_path, rows):
    models = spark.createDataFrame(
        [("model_SmallOffice_pre1980_2A", "SmallOffice", "pre1980", "2A")],
        "model_id string, bldg_type string, bldg_vintage string, climate string",
    )
    writers.write_models(models, str(tmp_path / "models"))
    assert rows(readers.read_models(spark, str(tmp_path / "models"))) == rows(models)
    grid = spark.createDataFrame(
        [("DF_70_6_2_2_0_0", 70, 6, 2, 2, 0, 0)],
        "case_id string, hvac_tstat int, event_start int, event_hours int, precool_hours int, precool_deg int, reset_deg int",
    )
    writers.write_grid(grid, str(tmp_path / "grid"))
    back = readers.read_grid(spark, str(tmp_path / "grid"))
    assert rows(back) == rows(grid) and back.count() == 1


def test_output_requests(spark, tmp_path, rows):
    (tmp_path / "req.csv").write_text(
        "key,report,variable_name,reporting_frequency\n"
        ",variable,Site Wind Speed,timestep\n"
        '"Zone 1, Zone 2",variable,Zone Mean Air Temperature,timestep\n'
        ",meter,Electricity:Facility,timestep\n"
    )
    got = readers.read_output_requests(spark, str(tmp_path / "req.csv"))
    assert rows(got, "key", "variable_name") == [
        ("Zone 1", "Zone Mean Air Temperature"), ("Zone 2", "Zone Mean Air Temperature"),
        (None, "Electricity:Facility"), (None, "Site Wind Speed"),
    ]
    assert "reporting_schedule" in got.columns


def test_failed_and_broken_documents_stay(spark, tmp_path):
    for name, text in {"good": '{"steps": [{"measure_dir_name": "m"}]}', "failed": '{"completed_status": "Fail"}', "broken": '{"steps": ['}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = readers.read_workflow_results(spark, str(tmp_path)).collect()
    assert {(r.document.split("/")[-1], r.status) for r in got} == {
        ("good.json", "ok"), ("failed.json", "no_steps"), ("broken.json", "unreadable")
    }


def test_workflow_results(spark, tmp_path):
    document = {
        "completed_status": "Success",
        "started_at": "20191120T183200Z",
        "steps": [
            {"measure_dir_name": "SetTimestep", "arguments": {"timestep": "4"},
             "result": {"step_result": "Success", "step_values": [{"name": "timestep", "value": 4}]}},
            {"measure_dir_name": "Setpoint",
             "result": {"step_result": "Success", "step_warnings": ["w"],
                        "step_values": [{"name": "cooling", "value": 4.5}, {"name": "timestep", "value": "late"}]}},
            {"measure_dir_name": "NotRun"},
        ],
    }
    (tmp_path / "out.json").write_text(json.dumps(document, indent=1))
    values = readers.read_workflow_results(spark, str(tmp_path / "out.json"))
    got = sorted((r.step_pos, r.measure, r.name, r.value) for r in values.where("name is not null").collect())
    assert got == [(0, "SetTimestep", "timestep", "4"), (1, "Setpoint", "cooling", "4.5"), (1, "Setpoint", "timestep", "late")]
    assert values.where("measure = 'NotRun'").count() == 1
    first = requests.first_step_with(values, "timestep", ["document"]).first()
    assert (first.step_pos, first.measure, first.value) == (0, "SetTimestep", "4")


@pytest.mark.parametrize("name", ["model_list_files", "workflow_result_files", "params_json_files"])
def test_texts_take_files_by_bucket_and_not_by_row(spark, tmp_path, monkeypatch, name):
    from demandloom.plans import file_queries
    from demandloom.plans.catalog import QUERIES

    (tmp_path / "in").mkdir()
    suppliers = spark.range(300).selectExpr(
        "id AS s_suppkey", "format_string('Supplier#%09d', id) AS s_name", "CAST(id % 25 AS INT) AS s_nationkey", "0.5D AS s_acctbal"
    )
    suppliers.write.parquet(str(tmp_path / "in" / "supplier.parquet"))
    monkeypatch.setattr(file_queries, "scratch_dir", lambda _, label: str(tmp_path / "scratch" / label))
    assert QUERIES[name](spark, str(tmp_path / "in")).count() >= 300
    written = [p for p in (tmp_path / "scratch").rglob("part-*") if p.is_file()]
    assert 0 < len(written) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_in_buckets_and_in_files_read_alike(spark, tmp_path, rows):
    texts = {"a": '[[{"measure_dir_name":"M",\n"arguments":{"x":"1"}}]]', "b": "[]", "c": "[[{", "d": "x"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    stored = spark.createDataFrame(list(texts.items()), "file string, document string")
    writers.write_documents(stored, str(tmp_path / "buckets"), "file", buckets=2)
    in_files = readers.read_model_list(spark, str(tmp_path / "*.json"))
    in_buckets = readers.read_model_list(spark, str(tmp_path / "buckets"), "buckets")
    name = F.regexp_extract("file", "([a-d])(.json)?$", 1).alias("name")
    shown = [name, F.col("step.measure_dir_name"), "status"]
    assert rows(in_buckets.select(*shown)) == rows(in_files.select(*shown))
    assert in_buckets.count() == 4
