"""Long reports in SQLite, as simulation runs leave them: a data source of Spark.

A run is a folder with a report file; the folder's name is the run. Each file is a partition of its
own. Conditions on the run choose files; those on key, name and frequency become the file's
own WHERE, so rows of other outputs never leave it. Folders have to be reachable under the same
path from the driver and all executors.
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from demandloom import schemas
from demandloom.constants import OUTPUT_SPEC
from demandloom.operators.collection import Spec, filter_report

FORMAT = "report_sqlite"
# --- fixed values: the report file of a run, and its view of values with their names ---
REPORT_FILE = "eplusout.sql"
REPORT_VIEW = "ReportVariableWithTime"
FILE_COLUMNS = {"key_value": "KeyValue", "name": "Name", "reporting_frequency": "ReportingFrequency"}

_BATCH_ROWS = 50_000
_SCHEMA = pa.schema(
    [
        ("run_id", pa.string()), ("step_no", pa.int64()), ("key_value", pa.string()), ("name", pa.string()),
        ("reporting_frequency", pa.string()), ("value", pa.float64()),
    ]
)

Condition = tuple[str, list]


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def where_of(filters: Iterable[Filter]) -> tuple[list[Condition], list[Filter], list[Filter]]:
    """``(conditions of the file, filters on the run, filters left to Spark)``; null compares as in Spark."""
    conditions, runs, rest = [], [], []
    for one in filters:
        attribute = getattr(one, "attribute", ())  # a negation has none
        column = attribute[0] if len(attribute) == 1 else None
        if column == "run_id" and isinstance(one, (EqualTo, In)):
            runs.append(one)
        elif column == "run_id" and isinstance(one, IsNotNull):
            continue  # a folder has a name
        elif column not in FILE_COLUMNS:
            rest.append(one)
        elif isinstance(one, EqualTo) or isinstance(one, EqualNullSafe) and one.value is not None:
            conditions.append((f"{FILE_COLUMNS[column]} = ? COLLATE BINARY", [one.value]))
        elif isinstance(one, In):
            marks = ", ".join("?" for _ in one.value)
            conditions.append((f"{FILE_COLUMNS[column]} COLLATE BINARY IN ({marks})", list(one.value)))
        elif isinstance(one, StringStartsWith):
            conditions.append((f"substr({FILE_COLUMNS[column]}, 1, ?) = ? COLLATE BINARY", [len(one.value), one.value]))
        elif isinstance(one, (IsNull, EqualNullSafe)):
            conditions.append((f"{FILE_COLUMNS[column]} IS NULL", []))
        elif isinstance(one, IsNotNull):
            conditions.append((f"{FILE_COLUMNS[column]} IS NOT NULL", []))
        else:
            rest.append(one)
    return conditions, runs, rest


def _where_of_spec(rules: list[list[str | None]]) -> Condition:
    """Any of the outputs ``(key or None for every key, name, frequency)``."""
    parts, values = [], []
    for key, name, frequency in rules:
        own = ["Name = ? COLLATE BINARY", "ReportingFrequency = ? COLLATE BINARY"] + ([] if key is None else ["KeyValue = ? COLLATE BINARY"])
        parts.append(f"({' AND '.join(own)})")
        values += [name, frequency] + ([] if key is None else [key])
    return " OR ".join(parts), values


@dataclass
class ReportFile(InputPartition):
    run_id: str
    path: str


class _PlainReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.root = _local(options["path"])
        self.file = options.get("file", REPORT_FILE)
        self.missing = options.get("missing", "error")
        self.conditions: list[Condition] = [_where_of_spec(json.loads(options["spec"]))] if options.get("spec") else []
        self.runs: list[Filter] = []

    def _asked_for(self, run: str) -> bool:
        return all(run == one.value if isinstance(one, EqualTo) else run in one.value for one in self.runs)

    def partitions(self) -> list[ReportFile]:
        found = []
        with os.scandir(self.root) as folders:
            for folder in folders:
                run = unquote(folder.name)
                if not folder.is_dir() or folder.name.startswith((".", "_")) or not self._asked_for(run):
                    continue
                path = os.path.join(folder.path, self.file)
                if os.path.exists(path):
                    found.append(ReportFile(run, path))
                elif self.missing == "error":
                    raise FileNotFoundError(f"run {run} has no {self.file}; option missing=skip passes over such runs")
        return sorted(found, key=lambda part: part.run_id)

    def read(self, partition: ReportFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        where = " AND ".join(f"({text})" for text, _ in self.conditions) or "1"
        values = [value for _, own in self.conditions for value in own]
        query = f"SELECT KeyValue, Name, ReportingFrequency, Value FROM {REPORT_VIEW} WHERE {where}"
        database = sqlite3.connect(f"file:{quote(partition.path)}?mode=ro&immutable=1", uri=True)
        try:
            steps: dict[tuple, int] = {}  # rows so far of each output; an output is taken or left as a whole
            cursor = database.execute(query, values)
            while rows := cursor.fetchmany(_BATCH_ROWS):
                numbers = []
                for row in rows:
                    output = row[:3]
                    numbers.append(steps.get(output, 0))
                    steps[output] = numbers[-1] + 1
                keys, names, frequencies, amounts = zip(*rows)
                columns = [[partition.run_id] * len(rows), numbers, keys, names, frequencies, amounts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
        finally:
            database.close()


class _Reader(_PlainReader):
    """For sessions that push filters; others refuse a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        conditions, self.runs, rest = where_of(filters)
        self.conditions = self.conditions + conditions
        return rest


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Files are written under names of their own and get their final name when all tasks are done."""

    def __init__(self, options: Mapping[str, str]):
        self.root = _local(options["path"])
        self.file = options.get("file", REPORT_FILE)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        moves: list[tuple[str, str]] = []
        run, database = None, None

        def close() -> None:
            if database is not None:
                database.commit()
                database.close()

        for batch in iterator:
            for row in batch.to_pylist():
                if row["run_id"] is None:
                    raise ValueError("a report of no run has no file")
                if row["run_id"] != run:
                    close()
                    run = row["run_id"]
                    folder = os.path.join(self.root, quote(run, safe=" "))
                    os.makedirs(folder, exist_ok=True)
                    own = os.path.join(folder, f".{self.file}-{uuid.uuid4().hex}")
                    moves.append((own, os.path.join(folder, self.file)))
                    database = sqlite3.connect(own)
                    database.execute("PRAGMA journal_mode = OFF")
                    database.execute(f"CREATE TABLE {REPORT_VIEW} (KeyValue TEXT, Name TEXT, ReportingFrequency TEXT, Value REAL)")
                values = [row["key_value"], row["name"], row["reporting_frequency"], row["value"]]
                database.execute(f"INSERT INTO {REPORT_VIEW} VALUES (?, ?, ?, ?)", values)
        close()
        return _Written(moves)

    def commit(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for own, final in message.moves if message else []:
                os.replace(own, final)

    def abort(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for own, _ in message.moves if message else []:
                if os.path.exists(own):
                    os.remove(own)


class SqliteReports(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return schemas.REPORT

    def reader(self, schema) -> _PlainReader:
        return _Reader(self.options) if self.options.get("push", "true") == "true" else _PlainReader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def read_report_sqlite(
    spark: SparkSession, root: str, spec: Spec | None = OUTPUT_SPEC, file: str = REPORT_FILE, missing: str = "error"
) -> DataFrame:
    """Report rows of all runs below ``root``, restricted to ``spec`` within the files.

    ``step_no`` counts the rows of an output (key, name and frequency) in file order. ``missing``:
    what to do with a run folder without report, ``error`` or ``skip``. Further conditions reach the files
    where the session has ``spark.sql.python.filterPushdown.enabled``, as sessions of :func:`get_spark` do.
    """
    spark.dataSource.register(SqliteReports)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(FORMAT).option("file", file).option("missing", missing).option("push", push)
    if spec is None:
        return reader.load(root)
    rules = [list(rule) for rule in spec.values()]
    return filter_report(reader.option("spec", json.dumps(rules)).load(root), spec)


def write_report_sqlite(report: DataFrame, root: str, file: str = REPORT_FILE) -> None:
    """One SQLite file per run, with its rows in the order of ``step_no``.

    Rows of a run meet in one task, because they go into one file; a run is a year of intervals of its outputs.
    """
    report.sparkSession.dataSource.register(SqliteReports)
    columns = [field.split(" ")[0] for field in schemas.REPORT.split(", ")]
    rows = report.select(*columns).repartition("run_id").sortWithinPartitions("run_id", "step_no")
    rows.write.format(FORMAT).mode("append").option("file", file).save(root)
