"""What a scan of a clustered report reads."""

from pyspark.sql import functions as F

from demandloom.sources import readers, writers

GROUP = 64 * 1024


def report(spark, names=40, rows_per_name=4000):
    """Every name with 500 runs; the numbers of the runs are even."""
    return spark.range(names * rows_per_name).select(
        (F.col("id") % 500 * 2).cast("string").alias("run_id"), F.floor(F.col("id") / names).alias("step_no"),
        F.concat(F.lit("key "), F.col("id") % 3).alias("key_value"), F.format_string("output %02d", F.col("id") % names).alias("name"),
        F.lit("Hourly").alias("reporting_frequency"), F.rand(1).alias("value"),
    )


def scanned(df):
    """Number of rows the file scan handed on, and the rows of the result."""
    kept = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value(), len(kept)


def test_one_output_reads_its_share(spark, tmp_path):
    rows = report(spark)
    writers.write_report(rows, str(tmp_path / "clustered"), row_group_bytes=GROUP)
    rows.repartition(4).write.option("parquet.block.size", GROUP).parquet(str(tmp_path / "plain"))
    spec = {"wanted": ("key 1", "output 17", "Hourly")}
    read, kept = scanned(readers.read_report(spark, str(tmp_path / "clustered"), spec))
    read_plain, kept_plain = scanned(readers.read_report(spark, str(tmp_path / "plain"), spec))
    assert kept == kept_plain == rows.where("name = 'output 17' AND key_value = 'key 1'").count() > 0
    # Within a fifth of all rows, where a file in any order is read whole.
    assert read <= rows.count() / 5 < read_plain == rows.count()


def test_a_run_that_is_not_there_reads_nothing(spark, tmp_path):
    """An odd run number lies between those of the file, so only the Bloom filter can tell."""
    path = str(tmp_path / "clustered")
    many = report(spark, names=2, rows_per_name=60_000).withColumn(
        "run_id", (F.xxhash64("run_id", "step_no") % 1_000_000_000 * 2).cast("string")
    )
    writers.write_report(many, path, row_group_bytes=1024**2)
    plain = str(tmp_path / "plain")
    many.sortWithinPartitions("name", "step_no").write.parquet(plain)
    absent = F.col("run_id") == "500000001"
    assert scanned(readers.read_report(spark, path, None).where(absent)) == (0, 0)
    assert scanned(readers.read_report(spark, plain, None).where(absent))[0] > 0


def test_rows_survive_with_missing_names(spark, tmp_path):
    rows = report(spark, 2, 10).withColumn("name", F.when(F.col("step_no") > 3, F.col("name")))
    writers.write_report(rows, str(tmp_path / "r"))
    back = readers.read_report(spark, str(tmp_path / "r"), None)
    assert back.count() == 20 and back.where("name IS NULL").count() == rows.where("name IS NULL").count()
    writers.write_report(rows.limit(0), str(tmp_path / "none"))
    assert readers.read_report(spark, str(tmp_path / "none"), None).count() == 0
