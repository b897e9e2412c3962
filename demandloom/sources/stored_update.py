"""A stored table in buckets of its key, and updates that rewrite only the buckets they touch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from demandloom.session import shuffle_width

BUCKET = "_bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType(list(schema.fields)).add(BUCKET, IntegerType())).parquet(path)


def _write(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    # A hot bucket becomes several files; in dynamic mode only folders that get rows are replaced.
    (
        df.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *keys)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    )


@dataclass(frozen=True)
class StoredTable:
    """Rows at ``path``, in a folder per bucket by the hash of ``keys``. Made by :func:`write_table`."""

    path: str
    keys: tuple[str, ...]
    buckets: int
    schema: StructType

    def read(self, spark: SparkSession) -> DataFrame:
        return self.stored(spark).drop(BUCKET)

    def stored(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.path}/rows", self.schema)

    def with_bucket(self, df: DataFrame) -> DataFrame:
        """``df`` with its bucket; a key hashes as the type it is stored as."""
        kept = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*kept), F.lit(self.buckets)).cast("int"))


@dataclass(frozen=True)
class Staged:
    """Touched buckets as they will be, in a folder of their own."""

    path: str
    schema: StructType

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows of the touched buckets with what the merge said of them."""
        return _read(spark, self.path, self.schema).drop(BUCKET)


def write_table(df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> StoredTable:
    """Store ``df``. Keys of any number and size of groups; a null key is a key like others.

    About as many buckets as there are 256 MB of rows; an update reads and writes whole buckets.
    """
    if BUCKET in (name.lower() for name in df.columns):
        raise ValueError(f"{BUCKET} is the column of the folders")
    table = StoredTable(path, tuple(keys), buckets or shuffle_width(df.sparkSession), df.schema)
    _write(table.with_bucket(df), f"{path}/rows", keys)
    return table


def stage_update(table: StoredTable, changes: DataFrame, merge: Merge) -> Staged:
    """Work out the buckets touched by ``changes`` and write them beside the table, which stays as it is.

    ``merge(existing, changes)`` gets the stored rows of the touched buckets and gives their rows after the
    update. It must leave each touched bucket some row, as changes that keep or add keys do: a bucket
    without new rows is not replaced. Columns the table does not have, such as what was done, are staged and not
    published. Bucket numbers pass through the driver: at most ``table.buckets``, whatever the changes are.
    """
    touched = [row[0] for row in table.with_bucket(changes).select(BUCKET).distinct().collect()]
    existing = table.stored(changes.sparkSession).where(F.col(BUCKET).isin(touched)).drop(BUCKET)  # reads no other folder
    merged = merge(existing, changes)
    types = {f.name: f.dataType for f in table.schema.fields}
    merged = merged.select(*(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in merged.columns))
    staged = Staged(f"{table.path}/staged-{uuid4().hex}", merged.schema)
    _write(table.with_bucket(merged), staged.path, table.keys)
    return staged


def publish(table: StoredTable, spark: SparkSession, staged: Staged) -> None:
    """Put staged buckets in place of the table's.

    What is published does not depend on the state of the table, so this is repeated after a failure at any
    point. While folders change places a reader may find a bucket old, new or absent.
    """
    rows = _read(spark, staged.path, staged.schema)
    _write(rows.select(*table.schema.names, BUCKET), f"{table.path}/rows", table.keys)


def update(table: StoredTable, changes: DataFrame, merge: Merge) -> DataFrame:
    """Merge ``changes`` into the table; returns the rows of the touched buckets, with what was done.

    Updates of one table have to come one after the other.
    """
    spark = changes.sparkSession
    staged = stage_update(table, changes, merge)
    publish(table, spark, staged)
    return staged.read(spark)


def replace_groups(table: StoredTable) -> Merge:
    """A merge after which each key named in the changes, say a run done again, has the changes' rows only."""

    def merge(existing: DataFrame, changes: DataFrame) -> DataFrame:
        named = changes.select(*(F.col(k).alias(f"_named_{k}") for k in table.keys)).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_named_{k}")) for k in table.keys]
        return existing.join(named, same, "left_anti").unionByName(changes.select(*existing.columns))

    return merge
