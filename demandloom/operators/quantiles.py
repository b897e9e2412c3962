"""Exact quantiles and box-plot numbers of a few groups of any size.

A group is never sorted or gathered. Its rows are counted per bucket of values, the bucket that holds a
wanted rank is counted in finer buckets, and so on; after three rounds a bucket spans so few of the numbers that a double
can be that its distinct values are few, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per doubling of the absolute value in the first round, buckets per bucket in the later ones.
PER_OCTAVE = 64
FINER = 65536
FINER_ROUNDS = 2
_ABOVE_ALL = 1 << 20


def _coarse(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises: sign and logarithm."""
    size = F.abs(v)
    level = (
        F.when(size == 0, 0)
        .when(size == F.lit(float("inf")), 2 * _ABOVE_ALL)
        .otherwise(F.floor(F.log2(size) * PER_OCTAVE) + _ABOVE_ALL)
    )
    return F.when(v < 0, -level).otherwise(level).cast("long")


def _fine(v: Column, low: Column, high: Column) -> Column:
    """The bucket of ``v`` among :data:`FINER` even ones from ``low`` to ``high``."""
    return F.when(high > low, F.floor((v - low) / (high - low) * FINER)).otherwise(0).cast("long")


def _holding(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """For each target of a group (``_rank`` among its rows) the bucket that holds it, and its rank inside."""
    line = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_n").over(line)).withColumn("_before", F.col("_upto") - F.col("_n"))
    held = upto.withColumn("_targets", F.filter("_targets", lambda t: (t["_rank"] >= F.col("_before")) & (t["_rank"] < F.col("_upto"))))
    moved = F.transform("_targets", lambda t: F.struct((t["_rank"] - F.col("_before")).alias("_rank"), t["_wanted"].alias("_wanted")))
    return held.where(F.size("_targets") > 0).withColumn("_targets", moved).drop("_upto", "_before", "_n")


def _inside(data: DataFrame, asked: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Rows whose value lies in an asked bucket (coarse number, smallest and largest value), with the bucket."""
    met = data.withColumn("_path", _coarse(F.col("_v"))).join(F.broadcast(asked) if few else asked, [*keys, "_path"])
    return met.where(F.col("_v").between(F.col("_low"), F.col("_high")))


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float] = (0.25, 0.5, 0.75), few: bool = False
) -> DataFrame:
    """``(keys, n, q)``: the number of values of each group and an array with the quantile at each of ``probabilities``.

    Quantiles between two neighbouring values lie on a straight line (position ``p * (n - 1)``). Missing values and NaN
    do not count; a group without any other value is not in the result. ``few``: what the keys are (hours, months) bounds
    the number of groups by some thousands, so what is sought per group is broadcast and no row of ``rows`` is shuffled
    before it is counted. The counts of a group are at most a bucket range each, so a window over them is bounded.
    """
    names, keys = list(keys), [*keys, "_all"]
    data = rows.withColumn("_v", F.col(value).cast("double")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    data = data.select(*names, F.lit(0).alias("_all"), "_v")
    # Groups are matched by equality, where a missing key would fall out.
    data = data.withColumns({k: F.struct(F.col(k).alias("k")) for k in names})
    count = F.count(F.lit(1)).alias("_n")

    coarse = data.groupBy(*keys, _coarse(F.col("_v")).alias("_bucket")).agg(count, F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    spots = F.array(*(F.lit(float(p)) * (F.col("_size") - 1) for p in probabilities))
    ranks = F.array_distinct(F.flatten(F.transform(spots, lambda s: F.array(F.floor(s), F.ceil(s)))))
    targets = F.transform(ranks, lambda r: F.struct(r.alias("_rank"), r.alias("_wanted")))
    sized = coarse.withColumn("_size", F.sum("_n").over(Window.partitionBy(*keys))).withColumn("_targets", targets)
    found = _holding(sized, keys).withColumnRenamed("_bucket", "_path")

    # What is sought goes along with the buckets, so every round names the one before it once.
    parent = [*keys, "_size", "_path", "_low", "_high", "_targets"]
    for _ in range(FINER_ROUNDS):
        bucket = _fine(F.col("_v"), F.col("_low"), F.col("_high")).alias("_bucket")
        finer = _inside(data, found, keys, few).groupBy(*parent, bucket).agg(count, F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        found = _holding(finer, parent[:-1]).select(*keys, "_size", "_path", F.col("_min").alias("_low"), F.col("_max").alias("_high"), "_targets")
    single = _inside(data, found, keys, few).groupBy(*parent, F.col("_v").alias("_bucket")).agg(count)
    exact = _holding(single, parent[:-1]).select(*keys, "_size", F.explode("_targets._wanted").alias("_wanted"), "_bucket")
    values = exact.groupBy(*keys, "_size").agg(F.map_from_entries(F.collect_set(F.struct("_wanted", "_bucket"))).alias("_at"))

    def between(position: Column) -> Column:
        low, high = F.element_at("_at", F.floor(position)), F.element_at("_at", F.ceil(position))
        part = position - F.floor(position)
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return values.select(
        *(F.col(f"{k}.k").alias(k) for k in names), F.col("_size").alias("n"), F.transform(spots, between).alias("q")
    )


def fleet_box_stats(
    rows: DataFrame, value: str, keys: Sequence[str] = ("hour",), reach: float = 1.5, few: bool = True
) -> DataFrame:
    """``(keys, n, mean, q1, median, q3, whisker_low, whisker_high, n_outliers)``, as ``metrics.box_stats``, for groups of any size.

    Values and ``few`` as in :func:`exact_quantiles`; set ``few`` to False where the keys do not bound the number of groups.
    """
    keys, v = list(keys), F.col("_v")
    q1, q3 = F.col("q")[0], F.col("q")[2]
    boxes = exact_quantiles(rows, keys, value, few=few).select(
        *(F.col(k).alias(f"_key_{k}") for k in keys), "q", (q1 - reach * (q3 - q1)).alias("_from"), (q3 + reach * (q3 - q1)).alias("_to")
    )
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.lit(True))
    data = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    met = data.join(F.broadcast(boxes) if few else boxes, same)
    inside = v.between(F.col("_from"), F.col("_to"))
    return met.groupBy(*keys, "q").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(F.when(inside, v)).alias("_lowest"),
        F.max(F.when(inside, v)).alias("_highest"), F.count_if(~inside).alias("n_outliers"),
    ).select(
        *keys, "n", "mean", q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"),
        F.least("_lowest", q1).alias("whisker_low"), F.greatest("_highest", q3).alias("whisker_high"), "n_outliers",
    )
