"""The data source for SQLite reports."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from demandloom import get_spark
from demandloom.constants import OUTPUT_SPEC
from demandloom.sources import sqlite_reports as source

SCHEMA = "run_id string, step_no bigint, key_value string, name string, reporting_frequency string, value double"


def published(folder, rows):
    """A report as a simulator leaves it: a view over values and their dictionary."""
    folder.mkdir(parents=True)
    with sqlite3.connect(folder / source.REPORT_FILE) as db:
        db.execute("CREATE TABLE Dictionary (Id INTEGER PRIMARY KEY, KeyValue TEXT, Name TEXT, ReportingFrequency TEXT)")
        db.execute("CREATE TABLE Data (DictionaryId INTEGER, Value REAL)")
        db.execute(
            f"CREATE VIEW {source.REPORT_VIEW} AS SELECT Value, KeyValue, Name, ReportingFrequency FROM Data JOIN Dictionary ON Id = DictionaryId"
        )
        outputs = list(dict.fromkeys(row[:3] for row in rows))
        db.executemany("INSERT INTO Dictionary VALUES (?, ?, ?, ?)", [(i, *output) for i, output in enumerate(outputs)])
        db.executemany("INSERT INTO Data VALUES (?, ?)", [(outputs.index(row[:3]), row[3]) for row in rows])


OAT = OUTPUT_SPEC["oat_c"]
ELEC = OUTPUT_SPEC["elec_j"]


@pytest.fixture
def root(tmp_path):
    key = ELEC[0] or "Whole Building"
    other = [(OAT[0], OAT[1], "Hourly", 99.0), ("Zone 1", OAT[1], OAT[2], 98.0), (None, "Fans", OAT[2], None)]
    for run, shift in (("base", 0.0), ("reset 4", 10.0)):
        rows = []
        for i in range(3):
            rows += [(OAT[0], OAT[1], OAT[2], i + shift), (key, ELEC[1], ELEC[2], 100.0 * i), *other]
        published(tmp_path / "runs" / run, rows)
    return str(tmp_path / "runs")


def test_outputs_asked_for(spark, root, rows):
    got = source.read_report_sqlite(spark, root)
    assert rows(got.where("name <> 'Electricity:Facility'"), "run_id", "step_no", "value") == sorted(
        [(run, i, i + shift) for run, shift in (("base", 0.0), ("reset 4", 10.0)) for i in range(3)], key=str
    )
    assert got.count() == 12
    assert source.read_report_sqlite(spark, root, None).count() == 30


def test_conditions_reach_the_files(spark, root):
    """The plan leaves no condition on key, name, frequency or run to Spark, and other files are not opened."""
    whole = source.read_report_sqlite(spark, "file://" + root, None)
    picked = whole.where((F.col("name") == OAT[1]) & F.col("key_value").isin("Zone 1", "x") & (F.col("run_id") == "base"))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("Filters", "")
    assert picked.rdd.getNumPartitions() == 1
    assert [tuple(r) for r in picked.orderBy("step_no").collect()] == [("base", i, "Zone 1", OAT[1], OAT[2], 98.0) for i in range(3)]
    kept = whole.where((F.col("value") > 10) & F.col("key_value").isNull())
    assert kept.count() == 0 and whole.where("key_value is null").count() == 6
    assert whole.where("name like 'Fan%' and key_value <=> null").count() == 6
    assert "Filter" in kept._jdf.queryExecution().executedPlan().toString()


def test_where_the_session_does_not_push(spark, root):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert source.read_report_sqlite(spark, root).count() == 12
        assert source.read_report_sqlite(spark, root, None).where("run_id = 'base' and name = 'Fans'").count() == 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_the_file_answers_with_the_rows_asked_for(root):
    """What the reader takes from a file is what its own WHERE gives."""
    reader = source._Reader({"path": root})
    assert list(reader.pushFilters([source.EqualTo(("name",), "Fans"), source.In(("run_id",), ("base", "z"))])) == []
    (part,) = reader.partitions()
    assert [batch.num_rows for batch in reader.read(part)] == [3]
    text, values = source._where_of_spec([["k", "n", "f"], [None, "m", "f"]])
    assert text.count("?") == len(values) == 5


def test_names_are_compared_as_spark_compares_them(spark, tmp_path):
    published(tmp_path / "runs" / "a", [("K", "Fans", "f", 1.0), ("k", "fans", "f", 2.0), ("k", "Fans ", "f", 3.0)])
    whole = source.read_report_sqlite(spark, str(tmp_path / "runs"), None)
    assert [r.value for r in whole.where("name = 'Fans'").collect()] == [1.0]
    assert [r.value for r in whole.where("key_value in ('k')").orderBy("value").collect()] == [2.0, 3.0]


def test_missing_reports(spark, root):
    os.makedirs(f"{root}/broken")
    with pytest.raises(Exception, match="broken"):
        source.read_report_sqlite(spark, root).collect()
    assert source.read_report_sqlite(spark, root, missing="skip").count() == 12


def test_written_files_read_back(spark, tmp_path, rows):
    path = str(tmp_path / "out")
    report = spark.createDataFrame(
        [("a/b", 1, "k", "n", "f", 2.0), ("a/b", 0, "k", "n", "f", None), ("c", 0, None, "n", "f", 1.5), ("c", 0, "k", "m", "f", float("inf"))], SCHEMA
    )
    source.write_report_sqlite(report, path)
    assert rows(source.read_report_sqlite(spark, path, None)) == rows(report)
    assert not [name for _, _, names in os.walk(path) for name in names if name.startswith(".")]
    source.write_report_sqlite(report.where("run_id = 'c'").withColumn("value", F.lit(7.0)), path)  # replaces that run only
    assert rows(source.read_report_sqlite(spark, path, None).where("run_id = 'c'"), "value") == [(7.0,), (7.0,)]
    assert source.read_report_sqlite(spark, path, None).count() == 4
    with pytest.raises(Exception, match="no run"):
        source.write_report_sqlite(report.withColumn("run_id", F.lit(None).cast("string")), path)


def test_sessions_push_filters():
    assert get_spark().conf.get("spark.sql.python.filterPushdown.enabled") == "true"
