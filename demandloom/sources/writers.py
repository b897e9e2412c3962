"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.session import shuffle_width
from demandloom.sources.readers import ELEC_HEADER, OAT_HEADER


def _in_buckets(df: DataFrame, path: str, key: str, order: Sequence[str], buckets: int | None, rows_per_file: int):
    """A writer of ``df`` in folders by a hash of ``key``, which stays a column.

    The number of folders follows the session's shuffle width and not the number of
    keys; adaptive execution cuts a large bucket into several files.
    """
    count = buckets or shuffle_width(df.sparkSession)
    placed = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(count)).cast("int")).hint("rebalance", "bucket")
    return (
        placed.sortWithinPartitions("bucket", key, *order)
        .write.mode("overwrite").partitionBy("bucket").option("maxRecordsPerFile", rows_per_file)
    )


def write_wide(
    wide: DataFrame,
    path: str,
    run: str = "run_id",
    order: str = "step_no",
    fmt: str = "csv",
    buckets: int | None = None,
    rows_per_file: int = 5_000_000,
    folder_per_run: bool = False,
    parts_per_run: int = 1,
) -> None:
    """Wide series in buckets of runs, or on request in one folder per run.

    A folder per run suits few runs: rows of a run meet in ``parts_per_run`` tasks
    before writing, or every task would leave a small file in every folder.
    """
    if folder_per_run:
        placed = wide.repartition(F.col(run), F.pmod(F.xxhash64(order), F.lit(parts_per_run)))
        writer = (
            placed.sortWithinPartitions(run, order)
            .write.mode("overwrite").partitionBy(run).option("maxRecordsPerFile", rows_per_file)
        )
    else:
        writer = _in_buckets(wide, path, run, [order], buckets, rows_per_file)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_meter(meter: DataFrame, path: str, rows_per_file: int = 50_000_000) -> None:
    """Interval series of any number of runs, in one folder per month.

    Studies look at some months only and then read no others. The rows are
    rebalanced by month: adaptive execution cuts a large month into as many tasks
    as its size asks for, so their number grows with the data.
    """
    (
        meter.withColumn("month", F.month("ts")).hint("rebalance", "month")
        .sortWithinPartitions("month", "run_id", "ts")
        .write.mode("overwrite").partitionBy("month").option("maxRecordsPerFile", rows_per_file).parquet(path)
    )


def write_report(report: DataFrame, path: str, row_group_bytes: int = 128 * 1024**2, distinct: int = 100_000) -> None:
    """Long report table, laid out so that a scan for some outputs skips the rest.

    Rows are in ranges of name, key and run, which split a name that most rows have, and sorted, so the
    smallest and largest name and key of a row group tell most groups apart. Bloom filters (sized for ``distinct``
    values of a row group) tell whether a group that spans a name, key or run holds it.
    """
    place = ["name", "key_value", "run_id"]
    out = report.repartitionByRange(*place).sortWithinPartitions(*place, "step_no").write.mode("overwrite")
    for column in place:
        out = out.option(f"parquet.bloom.filter.enabled#{column}", True).option(f"parquet.bloom.filter.expected.ndv#{column}", distinct)
    out.option("parquet.block.size", row_group_bytes).parquet(path)


def with_published_headers(wide: DataFrame) -> DataFrame:
    """Wide series with the column titles of the interval files."""
    return wide.select(
        "run_id", "ts", F.col("oat_c").alias(OAT_HEADER), F.col("elec_j").alias(ELEC_HEADER)
    )


def write_params_json(params: DataFrame, path: str) -> None:
    """Flat records, one JSON object per line."""
    params.write.mode("overwrite").json(path)


def write_documents(
    documents: DataFrame, path: str, case: str = "case_id", buckets: int | None = None, folder_per_case: bool = False,
    rows_per_file: int = 1_000_000,
) -> None:
    """JSON documents with their case as records in buckets, or on request one text file per case, in its folder."""
    rows = documents.select(case, "document")
    if folder_per_case:
        rows.repartition(case).write.mode("overwrite").partitionBy(case).text(path)
    else:
        _in_buckets(rows, path, case, [], buckets, rows_per_file).json(path)


def _write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_grid(grid: DataFrame, path: str) -> None:
    _write_csv(
        grid, path,
        ["case_id", "hvac_tstat", "event_start", "event_hours", "precool_hours", "precool_deg", "reset_deg"],
    )


def write_models(models: DataFrame, path: str) -> None:
    _write_csv(models, path, ["model_id", "bldg_type", "bldg_vintage", "climate"])
