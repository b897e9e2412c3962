"""Even time series as variable intervals, and back.

A series is one row per step (a whole number: half hours, minutes). Its intervals are the longest runs of
steps with one value. Runs are first found within blocks of steps, each a task of its own; only the runs that touch a
border of their block go on to the next, larger blocks, so no task sees a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Steps per block, one level after the other: a task stitches at most two runs per block of the level before.
BLOCKS = (4096, 4096 * 4096)


def _stitched(runs: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Neighbouring runs (``begin_step``, ``end_step``) of a group joined where they meet with one value."""
    line = Window.partitionBy(*group).orderBy("begin_step", "end_step", value)
    follows = (F.col("begin_step") == F.lag("end_step").over(line) + 1) & F.col(value).eqNullSafe(F.lag(value).over(line))
    starts = runs.withColumn("_starts", F.when(follows, 0).otherwise(1))
    numbered = starts.withColumn("_run", F.sum("_starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # The value is the same in a run, and part of the key so that the grouping stays a hash aggregation.
    return numbered.groupBy(*group, "_run", value).agg(F.min("begin_step").alias("begin_step"), F.max("end_step").alias("end_step")).drop("_run")


def to_intervals(
    series: DataFrame, keys: Sequence[str], step: str = "step", value: str = "value", blocks: Sequence[int] = BLOCKS
) -> DataFrame:
    """``(keys, begin_step, end_step, value)``: the longest runs of consecutive steps with one value, both ends included.

    A missing value is a value of its own, a missing step ends a run, and a step that is there twice with one value makes two
    runs. Rows without a step have no place and stay out. ``blocks`` have to be multiples of each other.
    """
    keys = list(keys)
    runs = series.where(F.col(step).isNotNull()).select(
        *keys, F.col(step).cast("long").alias("begin_step"), F.col(step).cast("long").alias("end_step"), value
    )
    return stitch_runs(runs, keys, value, blocks)


def stitch_runs(
    runs: DataFrame, keys: Sequence[str], value: str = "value", blocks: Sequence[int] = BLOCKS, within: int | None = None
) -> DataFrame:
    """The same from runs (``begin_step``, ``end_step``) that do not cross a border of the first ``blocks``.

    With ``within`` they are the longest ones in blocks of that many steps already, such as days, and cross none of
    their borders: the inner ones are done as they are, and no more than two of a block go through the windows.
    """
    keys, done = list(keys), []

    def split(size: int) -> DataFrame:
        """What touches a border of its block; the rest is done."""
        inner = (F.col("begin_step") > F.col("_block") * size) & (F.col("end_step") < (F.col("_block") + 1) * size - 1)
        done.append(runs.where(inner))
        return runs.where(~inner)

    if within:
        runs = runs.withColumn("_block", F.floor(F.col("begin_step") / F.lit(within)))
        runs = split(within)
    for size in blocks:
        block = F.floor(F.col("begin_step") / F.lit(size))
        runs = _stitched(runs.withColumn("_block", block), [*keys, "_block"], value)
        runs = split(size)
    done.append(_stitched(runs.drop("_block"), keys, value))
    columns = [*keys, "begin_step", "end_step", value]
    return reduce(DataFrame.unionByName, (part.select(*columns) for part in done))


def from_intervals(intervals: DataFrame, keys: Sequence[str], value: str = "value", block: int = 4096) -> DataFrame:
    """``(keys, step, value)``: a row for each step of each interval; a long interval unfolds block by block."""
    first = F.col("_first")
    parts = intervals.where(F.col("begin_step") <= F.col("end_step")).select(
        *keys, value, "end_step", F.explode(F.sequence("begin_step", "end_step", F.lit(block).cast("long"))).alias("_first")
    )
    last: Column = F.least(first + (block - 1), F.col("end_step"))
    return parts.select(*keys, F.explode(F.sequence(first, last)).alias("step"), value)
