"""Running sums of long sequences, each cut into blocks that are tasks of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE_ALL = -(1 << 62)


def running_sum(
    rows: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, ties: Sequence[str] = (), block: int = 1024
) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows of their ``keys`` up to and with each.

    ``order`` is a number; rows of equal ``order`` go by ``ties``, those without one come first. A block holds the rows of ``block``
    consecutive numbers. Blocks are summed on their own, the sums before each block are added up in a short scan (one
    row per block), and rows are added up within their block, so no sequence has to fit into one task.
    """
    keys = list(keys)
    placed = rows.withColumns({"_value": value, "_block": F.coalesce(F.floor(F.col(order) / block), F.lit(_BEFORE_ALL)).cast("long")})
    sums = placed.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_block", F.sum("_sum").over(earlier).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_value").over(within) + F.coalesce("_before", F.lit(0))
    return placed.join(offsets.hint("merge"), [*keys, "_block"]).withColumn(name, total).drop("_value", "_block", "_before")
