"""Readers. Schemas are stated, so no file is read twice to guess them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom import schemas
from demandloom.constants import OUTPUT_SPEC
from demandloom.functions.calendar import interval_start
from demandloom.operators.collection import filter_report

# --- fixed values: headers of the interval files ---
OAT_HEADER = "Environment:Site Outdoor Air Drybulb Temperature [C](TimeStep)"
ELEC_HEADER = "Electricity:Facility [J](TimeStep)"

# Header of a file and name of the column.
OUTPUTS = {OAT_HEADER: "oat_c", ELEC_HEADER: "elec_j"}

OK, UNREADABLE, NO_STEPS = "ok", "unreadable", "no_steps"


def _header_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    if schema:
        # The header decides which column is which; order in the file is free.
        return reader.schema(schema).option("enforceSchema", False).csv(path)
    return reader.csv(path)


def read_meter(
    spark: SparkSession, path: str, start: str = "2017-01-01 00:00:00", step_minutes: int = 15,
    schema: str = schemas.METER_RAW,
) -> DataFrame:
    """Interval files with an explicit step number; time is start + step."""
    raw = _header_csv(spark, path, schema)
    return raw.withColumn("ts", interval_start(start, F.col("step_no"), step_minutes))


def read_stored_meter(spark: SparkSession, path: str) -> DataFrame:
    """Interval series stored by :func:`write_meter`."""
    return spark.read.schema(schemas.METER + ", month int").parquet(path)


def read_runs(
    spark: SparkSession, root: str, layout: str = "partitions", start: str = "2017-01-01 00:00:00", step_minutes: int = 15,
    outputs: Mapping[str, str] = OUTPUTS,
) -> DataFrame:
    """Wide series of all runs below ``root``: ``run_id, ts`` and the columns of ``outputs``.

    ``partitions``: folders ``run_id=<run>``, as :func:`write_wide` leaves them;
    a filter on the run then skips folders. ``buckets``: folders ``bucket=<n>`` with the
    run as a column. The header has to be the one that is written there.

    ``files``: one published ``<run>.csv`` each. Columns are found by their header, in
    any order and with others beside them; a file without one of them is an error.
    The time is the column with the blank header, or else the row's place in the
    year. A file holds one run and one year, so it is read as a whole.
    """
    if layout == "files":
        return _published_runs(spark, root, start, step_minutes, outputs)
    values = ["ts timestamp_ntz", *(f"`{header}` double" for header in outputs)]
    schema = ", ".join((["run_id string"] if layout == "buckets" else []) + values)
    tail = ", bucket int" if layout == "buckets" else ", run_id string"
    runs = spark.read.option("header", True).schema(schema + tail).option("enforceSchema", False).csv(root)
    return runs.select("run_id", "ts", *(F.col(f"`{header}`").alias(name) for header, name in outputs.items()))


def _published_runs(spark, root, start, step_minutes, outputs) -> DataFrame:
    def cells(line):
        return F.transform(F.split(line, ","), lambda cell: F.trim(F.btrim(F.trim(cell), F.lit('"'))))

    texts = spark.read.option("pathGlobFilter", "*.csv").text(root, wholetext=True)
    files = texts.select(
        F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)).alias("run_id"),
        F.split("value", r"\r?\n").alias("lines"),
    ).select("run_id", "lines", cells(F.col("lines")[0]).alias("header"))
    found = {name: F.array_position("header", header).cast("int") for header, name in outputs.items()}
    places = {
        name: F.when(at > 0, at).otherwise(
            F.raise_error(F.concat(F.col("run_id"), F.lit(f": no column {header}"))).cast("int")
        )
        for (name, at), header in zip(found.items(), outputs)
    }
    rows = files.select(
        "run_id", F.array_position("header", "").cast("int").alias("_time"),
        *(at.alias(f"_{name}") for name, at in places.items()),
        F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("step_no", "line"),
    ).where(F.trim("line") != "")
    parsed = rows.withColumn("cells", cells(F.col("line")))
    by_place = interval_start(start, F.col("step_no"), step_minutes)
    time = F.when(F.col("_time") > 0, F.expr("try_element_at(cells, nullif(_time, 0))").cast("timestamp_ntz")).otherwise(by_place)
    return parsed.select(
        "run_id", time.alias("ts"),
        *(F.nullif(F.element_at("cells", F.col(f"_{name}")), F.lit("")).cast("double").alias(name) for name in outputs.values()),
    )


def read_documents(spark: SparkSession, path: str, case: str = "case_id") -> DataFrame:
    """Documents in buckets, as :func:`write_documents` leaves them."""
    return spark.read.schema(f"{case} string, document string, bucket int").json(path).select(case, "document")


def read_report(
    spark: SparkSession, path: str, spec: Mapping[str, tuple] | None = OUTPUT_SPEC
) -> DataFrame:
    """Long variable table (parquet), restricted to ``spec`` at the scan."""
    report = spark.read.schema(schemas.REPORT).parquet(path)
    return report if spec is None else filter_report(report, spec)


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """Design table; columns are whatever the header says, as text."""
    return _header_csv(spark, path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Measure lookup keyed by its first column, which becomes ``param``."""
    table = _header_csv(spark, path)
    return table.withColumnRenamed(table.columns[0], "param")


def read_params(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Parameter file whose header is replaced by canonical names."""
    return _header_csv(spark, path).toDF(*names)


def _texts(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """One row per text: ``file, value``.

    ``files``: one text per file, named by its path. ``buckets``: many texts per file with their names, as
    :func:`write_documents` leaves them under the case ``file``; a file costs more than most texts.
    """
    if layout == "buckets":
        return read_documents(spark, path, "file").withColumnRenamed("document", "value")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )


def parse_params_json(texts: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Arrays of flat objects (column ``value``) -> one row per object, all text, with a ``status``.

    A text that is no such array stays as one row without values.
    """
    record = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    parsed = texts.select(*keys, F.from_json("value", f"array<{record}>").alias("records"))
    status = F.when(F.col("records").isNull(), UNREADABLE).otherwise(OK)
    rows = parsed.select(*keys, status.alias("status"), F.explode_outer("records").alias("record"))
    return rows.select(*keys, *(F.col(f"record.{n}").alias(n) for n in names), "status")


def read_params_json(spark: SparkSession, path: str, names: Sequence[str], layout: str = "files") -> DataFrame:
    return parse_params_json(_texts(spark, path, layout), names, ["file"])


def parse_model_list(texts: DataFrame, key: str = "file") -> DataFrame:
    """Arrays of arrays of steps -> one row per model and step, with a ``status``.

    An unreadable text, an empty list and a model without steps stay as one row.
    """
    lists = texts.select(key, F.from_json("value", schemas.MODEL_LIST).alias("models"))
    models = lists.select(
        key, F.col("models").isNull().alias("_broken"), F.posexplode_outer("models").alias("model_no", "steps")
    )
    steps = models.select(key, "_broken", "model_no", F.posexplode_outer("steps").alias("step_pos", "step"))
    status = F.when(F.col("_broken"), UNREADABLE).when(F.col("step_pos").isNull(), NO_STEPS).otherwise(OK)
    return steps.select(key, "model_no", "step_pos", "step", status.alias("status"))


def read_model_list(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    return parse_model_list(_texts(spark, path, layout))


def parse_workflow_results(texts: DataFrame, key: str = "file") -> DataFrame:
    """Result documents -> one row per document, step and step value, with a ``status``.

    A document that cannot be read, or that failed before its first step, stays as
    one row.
    """
    shape = f"struct<{schemas.WORKFLOW_RESULT}, _broken:string>"
    parsed = F.from_json("value", shape, {"columnNameOfCorruptRecord": "_broken"})
    docs = texts.select(key, parsed.alias("doc")).select(
        key, "doc.completed_status", (F.col("doc").isNull() | F.col("doc._broken").isNotNull()).alias("_broken"),
        F.posexplode_outer("doc.steps").alias("step_pos", "step"),
    )
    status = F.when(F.col("_broken"), UNREADABLE).when(F.col("step_pos").isNull(), NO_STEPS).otherwise(OK)
    return docs.select(
        key, "completed_status", "step_pos", status.alias("status"),
        F.col("step.measure_dir_name").alias("measure"),
        F.col("step.result.step_result").alias("step_result"),
        F.explode_outer("step.result.step_values").alias("step_value"),
    ).select(
        key, "completed_status", "step_pos", "measure", "step_result",
        F.col("step_value.name").alias("name"), F.col("step_value.value").alias("value"), "status",
    )


def read_workflow_results(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    return parse_workflow_results(_texts(spark, path, layout)).withColumnRenamed("file", "document")


def explode_keys(requests: DataFrame) -> DataFrame:
    """One row per key of a comma list; no key means all objects."""
    keys = F.transform(F.split("key", ","), lambda k: F.trim(k))
    return requests.withColumn("key", F.explode_outer(keys))


def read_output_requests(spark: SparkSession, path: str) -> DataFrame:
    requests = _header_csv(spark, path)
    if "reporting_schedule" not in requests.columns:
        requests = requests.withColumn("reporting_schedule", F.lit(None).cast("string"))
    return explode_keys(requests)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Model dimension."""
    return _header_csv(spark, path).toDF("model_id", "bldg_type", "bldg_vintage", "climate")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return _header_csv(spark, path, schemas.GRID)
