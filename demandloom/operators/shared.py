"""What is equal in different models is kept once: day profiles and whole schedules by their content.

``links`` tables say which content a profile has (keys, ``shape_id``); a ``dictionary`` holds each
content once (``shape_id, points, n_uses``). An edit of shared profiles is an edit of the dictionary.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions import profiles as P
from demandloom.session import shuffle_width


def address(points: Column) -> Column:
    """Content address of a profile; equal for profiles that are the same step function."""
    return _address_of_shape(P.canonical(points))


def _address_of_shape(shape: Column) -> Column:
    """Never null, and Spark is told so: a join would else look for nulls below all edits, and work them out again there, nested in each other."""
    return F.coalesce(F.sha2(F.when(shape.isNull(), "none").otherwise(F.to_json(shape)), 256), F.lit(""))


def links(profiles: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Content of each profile. Moves no rows."""
    return profiles.select(*keys, address(F.col("points")).alias("shape_id"))


def dictionary(profiles: DataFrame) -> DataFrame:
    """Each content once, with the number of profiles that have it.

    Grouped by address and content, so content that met another's address is a
    second row and not lost: :func:`colliding` finds it. Copies are counted before the shuffle.
    """
    shaped = profiles.select(P.canonical(F.col("points")).alias("points")).withColumn("shape_id", _address_of_shape(F.col("points")))
    return shaped.groupBy("shape_id", "points").agg(F.count(F.lit(1)).alias("n_uses"))


def colliding(shapes: DataFrame) -> DataFrame:
    """Addresses that stand for more than one content. Empty, or the dictionary is not to be used."""
    return shapes.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_contents")).where("n_contents > 1")


def expand(profile_links: DataFrame, shapes: DataFrame) -> DataFrame:
    """Profiles of the links with the dictionary's points, also after its edit.

    A merge join on purpose: a content that a third of the profiles have is one hot key, which
    adaptive execution can cut, while the size of an edited dictionary is only estimated.
    """
    return profile_links.join(shapes.select("shape_id", "points").hint("merge"), "shape_id")


def readdress(profile_links: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and dictionary after an edit has made some contents equal, or an address outdated."""
    renamed = edited.select(F.col("shape_id").alias("_old"), P.canonical(F.col("points")).alias("points"), "n_uses")
    renamed = renamed.withColumn("shape_id", _address_of_shape(F.col("points")))
    moved = profile_links.withColumnRenamed("shape_id", "_old").join(renamed.select("_old", "shape_id").hint("merge"), "_old")
    shapes = renamed.groupBy("shape_id", "points").agg(F.sum("n_uses").alias("n_uses"))
    return moved.drop("_old"), shapes


def same_schedules(entries: DataFrame, content: Sequence[str], key: str = "schedule_id") -> DataFrame:
    """For each schedule the least one with the same entries, as ``shared_id``.

    ``entries`` has a row per profile of a schedule; ``content`` are the columns that count, such as the
    kind, the position of the rule and the ``shape_id``. Repeated entries count as often as they occur, a
    null is a value like another, and rows without a schedule belong to none.

    A schedule may have any number of entries, so they are not gathered: its size and a hash propose
    who is equal. Schedules proposed for each other are equal if together they have no more different
    entries than each of them; that is counted before the shuffle, so one content that most schedules
    have is no hot key. Where they have more, :func:`_looked_up` compares entry by entry.

    Entries move by schedule once, to as many partitions as shuffles start from. These are not joined to
    larger ones: they compress well, so that tasks of the usual size on disk need many times that in memory.
    All entries of one schedule meet in one task, which goes to disk if they are millions.
    """
    width = shuffle_width(entries.sparkSession)
    dealt = entries.where(F.col(key).isNotNull()).select(key, *content).repartition(width, key)
    unique = dealt.groupBy(key, *content).agg(F.count(F.lit(1)).alias("_n"))
    size, mark = F.count(F.lit(1)), F.bit_xor(_hash_of_entry(content, 1))
    own = Window.partitionBy(key)
    by = ["_size", "_mark"]
    # Never null, and Spark is told so: both uses of the marks can then share a shuffle.
    marks = unique.groupBy(key).agg(size.alias("_size"), F.coalesce(mark, F.lit(0)).alias("_mark"))
    marked = unique.select("*", size.over(own).alias("_size"), F.coalesce(mark.over(own), F.lit(0)).alias("_mark"))
    contents = marked.groupBy(*by, *content, "_n").agg(F.min(key).alias("_first"))
    groups = contents.groupBy(*by).agg(F.min("_first").alias("shared_id"), F.count(F.lit(1)).alias("_union"))
    alike = marks.join(groups.where("_union = _size").hint("merge"), by).select(key, "shared_id")
    doubtful = marks.join(groups.where("_union > _size").hint("merge"), by).select(key, F.col("shared_id").alias("_proposed"))
    return alike.unionByName(_looked_up(unique.join(doubtful, key), content, key))


def _hash_of_entry(content: Sequence[str], seed: int) -> Column:
    presence = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content] + [F.col(c).isNull() for c in content]
    return F.xxhash64(*presence, F.col("_n"), F.lit(seed))


def _looked_up(unique: DataFrame, content: Sequence[str], key: str) -> DataFrame:
    """:func:`same_schedules` entry by entry, for different entries with their number ``_n``, among those ``_proposed`` alike.

    Two sums of hashes propose once more who is equal, and every entry of a schedule is then looked up among those of
    the proposed one. A schedule that fails this stays on its own.
    """
    sums = [F.sum(_hash_of_entry(content, seed).cast("decimal(38,0)")).alias(f"_sum{seed}") for seed in (1, 2)]
    marks = unique.groupBy(key, "_proposed").agg(F.count(F.lit(1)).alias("_size"), *sums)
    by = ["_proposed", "_size", "_sum1", "_sum2"]
    proposed = marks.join(marks.groupBy(*by).agg(F.min(key).alias("_first")).hint("merge"), by).select(key, "_proposed", "_first", "_size")

    others = proposed.where(F.col(key) != F.col("_first"))
    mine = unique.join(others, [key, "_proposed"]).alias("mine")
    theirs = unique.withColumnRenamed(key, "_owner").alias("theirs")
    same = [F.col(f"mine.{c}").eqNullSafe(F.col(f"theirs.{c}")) for c in (*content, "_n")]
    here = (F.col("mine._proposed") == F.col("theirs._proposed")) & (F.col("mine._first") == F.col("theirs._owner"))
    met = mine.join(theirs, reduce(and_, same, here))
    held = met.groupBy(F.col(f"mine.{key}").alias(key)).agg(F.count(F.lit(1)).alias("_held"))
    equal = F.coalesce(F.col("_held") == F.col("_size"), F.lit(False))
    return proposed.join(held, key, "left").select(key, F.when(equal, F.col("_first")).otherwise(F.col(key)).alias("shared_id"))
