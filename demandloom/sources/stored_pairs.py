"""Baselines and scenarios stored side by side, so that pairing them moves no rows.

Both tables are bucketed by baseline and time. A scenario's row lies in the same bucket as the
baseline's row it is compared with, and a baseline with thousands of scenarios spreads over all buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.operators.metrics import PAIR_KEYS
from demandloom.session import shuffle_width

_SCHEMAS = {
    "baseline": "baseline_id STRING, ts {time}, oat_f DOUBLE, base_kw DOUBLE, n_runs BIGINT",
    "scenario": "baseline_id STRING, ts {time}, run_id STRING, floor_area DOUBLE, scenario_kw DOUBLE",
}


@dataclass
class StoredPairs:
    """Where the tables are, and what has to be known to read them."""

    path: str
    buckets: int
    time: str = "TIMESTAMP_NTZ"

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        """``baseline`` or ``scenario``; the catalog entry, which knows the buckets, is made anew for each session."""
        name = f"stored_{kind}_{uuid4().hex}"
        keys = ", ".join(PAIR_KEYS)
        spark.sql(
            f"CREATE TABLE {name} ({_SCHEMAS[kind].format(time=self.time)}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'"
        )
        return spark.table(name)

    def link(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("run_id string, baseline_id string, floor_area double").parquet(f"{self.path}/link")


def write_pairs(baseline: DataFrame, scenario: DataFrame, link: DataFrame, path: str, buckets: int | None = None) -> StoredPairs:
    """Store meters of baselines and scenarios below ``path``, with their ``link`` (``run_id, baseline_id, floor_area``).

    Each baseline row knows how many scenarios its baseline has; scenario rows carry their
    baseline and floor area. Rows of runs that the link does not name are not part of any pair and stay out, as
    in :func:`pair_with_baseline`. One file per bucket, so give about as many buckets as there are 256 MB of rows.
    """
    spark = baseline.sparkSession
    buckets = buckets or shuffle_width(spark)
    sizes = link.groupBy("baseline_id").agg(F.count(F.lit(1)).alias("n_runs"))
    base = baseline.select(F.col("run_id").alias("baseline_id"), "ts", "oat_f", F.col("bldg_kw").alias("base_kw"))
    loads = scenario.select("run_id", "ts", F.col("bldg_kw").alias("scenario_kw")).join(link, "run_id")
    tables = {"baseline": base.join(sizes, "baseline_id"), "scenario": loads}
    for kind, table in tables.items():
        columns = [field.split(" ")[0] for field in _SCHEMAS[kind].split(", ")]
        placed = table.select(*columns).repartition(buckets, *PAIR_KEYS)  # the tasks are the buckets
        name = f"written_{kind}_{uuid4().hex}"
        placed.write.bucketBy(buckets, *PAIR_KEYS).sortBy(*PAIR_KEYS).mode("overwrite").option("path", f"{path}/{kind}").saveAsTable(name)
    link.select("run_id", "baseline_id", "floor_area").write.mode("overwrite").parquet(f"{path}/link")
    return StoredPairs(path, buckets, base.schema["ts"].dataType.simpleString().upper())
