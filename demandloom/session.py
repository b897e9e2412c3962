"""Session helper and the one place that decides where scratch tables go."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter for these plans: adaptive re-planning (partition
# coalescing, skew-join splitting) and a fixed zone because every timestamp here
# is zone-less.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


# Shuffle partitions aim at this size, small enough to sort in an executor's
# share of memory.
PARTITION_BYTES = 256 * 1024**2


def sized_for(data_bytes: int) -> dict[str, str]:
    """Settings for a study that shuffles about ``data_bytes``.

    Adaptive execution joins small partitions but cannot cut large ones, so it
    has to start from enough of them.
    """
    partitions = max(200, math.ceil(data_bytes / PARTITION_BYTES))
    return {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
    }


def get_spark(
    app_name: str = "demandloom", master: str | None = None, data_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Build (or get) a session carrying :data:`SETTINGS`; ``conf`` overrides.

    Give ``data_bytes`` on a cluster, see :func:`sized_for`.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            conf = {"spark.ui.enabled": "false", **conf}
    sizes = sized_for(data_bytes) if data_bytes else {}
    for key, value in {**SETTINGS, **sizes, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions that shuffles of this session start from."""
    started = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(started or spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for a written table.

    The cluster names its shared folder in ``spark.checkpoint.dir``. A local
    temporary folder is used only when that is unset and the master is local;
    on a cluster a machine-local path would lose data with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="demandloom-")
    path = os.path.join(root, f"{label}-{uuid.uuid4().hex}")
    if hasattr(spark, "_jvm"):  # goes when the session's JVM ends
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def fixed_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A short list of literals as a table whose size Spark knows.

    A table made from Python rows counts as huge in the planner, which then
    shuffles (or broadcasts!) the other side of a join with it.
    """
    fields = [field.strip().split(" ", 1) for field in schema.split(",")]
    literals = [
        F.struct(*(F.lit(value).cast(kind).alias(name) for value, (name, kind) in zip(row, fields)))
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*literals)))
