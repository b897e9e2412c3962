"""Space types laid over the stories of a building.

The floor areas of a building's space types, one behind the other, are a line; so are those of its
stories. What a story holds of a type is the length that both share, so the layout is a join of
overlapping intervals. It runs on cells of the line: intervals name the cells they touch and meet in an
equi-join, and each pair counts in the cell where its overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.prefix import running_sum

# Areas up to this are rounding errors.
TOLERANCE = 0.0001


def with_interval(rows: DataFrame, order: str, area: str, tie: str, model: str = "model_id", block: int = 1024) -> DataFrame:
    """``rows`` with ``lo`` and ``hi``, their place on the line of their model; negative and missing areas take none."""
    own = F.greatest(F.coalesce(F.col(area), F.lit(0.0)), F.lit(0.0))
    summed = running_sum(rows, [model], order, own, "hi", [tie], block)
    return summed.withColumn("lo", F.col("hi") - own)


def overlaps(left: DataFrame, right: DataFrame, cell: DataFrame, model: str = "model_id") -> DataFrame:
    """Pairs of ``left`` and ``right`` intervals (``lo``, ``hi``) of a model that share more than the tolerance, as ``lo``, ``hi`` of the shared part.

    ``cell`` has ``cell``, the cell width of each model. The columns of both sides have to differ but for the model.
    """
    def cells(side: DataFrame, name: str) -> DataFrame:
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        touched = F.sequence(F.floor(low / F.col("cell")), F.floor(high / F.col("cell")))
        placed = side.where(F.col("hi") - F.col("lo") > TOLERANCE).withColumnsRenamed({"lo": f"_{name}_lo", "hi": f"_{name}_hi"})
        out = placed.join(cell, model).withColumn("_cell", F.explode(touched))
        return out if name == "left" else out.drop("cell")

    # Unfolded rows are more than their estimate says, so neither side is offered for broadcast.
    met = cells(left, "left").join(cells(right, "right").hint("merge"), [model, "_cell"])
    lo, hi = F.greatest("_left_lo", "_right_lo"), F.least("_left_hi", "_right_hi")
    once = F.floor(lo / F.col("cell")) == F.col("_cell")
    return met.where(once & (hi - lo > TOLERANCE)).withColumn("lo", lo).withColumn("hi", hi).drop("cell", "_cell", "_right_lo", "_right_hi")


def _cells(types: DataFrame, stories: DataFrame) -> DataFrame:
    """A cell is as long as a model's mean interval, so all its intervals together touch a few cells each."""
    every = types.select("model_id", "hi").unionByName(stories.select("model_id", "hi"))
    ends = every.groupBy("model_id").agg(F.max("hi").alias("_end"), F.count(F.lit(1)).alias("_n"))
    return ends.where(F.col("_end") > 0).select("model_id", (2 * F.col("_end") / F.col("_n")).alias("cell"))


def _trades(pieces: DataFrame, types: DataFrame) -> DataFrame:
    """For each upper border of a story that leaves a sliver of the type it cuts, how the area around it is dealt anew.

    ``_from`` to ``_to`` is the area in question, below ``_turn`` it goes to the story above and from there on to the one below.
    """
    least, more = F.col("min_area"), 5 * F.col("min_area")
    cut = pieces.join(types.select("model_id", "space_type", F.col("lo").alias("_a0"), F.col("hi").alias("_a1")), ["model_id", "space_type"]).where(
        (F.abs(F.col("hi") - F.col("_s1")) <= TOLERANCE) & (F.col("_a1") - F.col("_s1") > TOLERANCE)
        & F.col("_next_area").isNotNull() & (F.col("_a1") - F.col("_a0") >= least)
    )
    head, tail = F.col("_s1") - F.greatest("_a0", "_s0"), F.col("_a1") - F.col("_s1")
    half_below, half_above = (F.col("_s1") - F.col("_s0")) / 2, F.col("_next_area") / 2
    # The type gets more of this story, for area of the type before it; or less, for area of the type after it.
    grow = F.least(more, tail - least, half_below - head, half_above)
    shrink = F.least(more, head - least, half_below, half_above - tail)
    swap = F.when(head < least, grow).when(tail < least, shrink)
    kept = cut.withColumns({"_swap": swap, "_head": head < least}).where(F.col("_swap") >= least)
    start, stop = F.col("_a0"), F.col("_a1")
    return kept.select(
        "model_id", "story_no", "_head",
        F.when(F.col("_head"), start - F.col("_swap")).otherwise(F.col("_s1") - F.col("_swap")).alias("_from"),
        F.when(F.col("_head"), start).otherwise(stop).alias("_turn"),
        F.when(F.col("_head"), F.col("_s1") + F.col("_swap")).otherwise(stop + F.col("_swap")).alias("_to"),
    )


def lay_over_stories(space_types: DataFrame, stories: DataFrame, block: int = 1024) -> DataFrame:
    """``(model_id, story_no, space_type, area)``: how much of each space type each story holds.

    ``space_types``: ``model_id, space_type, type_order, floor_area``, laid down by ``type_order``. ``stories``:
    ``model_id, story_no, story_area, min_area``, filled from the lowest ``story_no``, which count up by one.
    Area beyond the last story, and all area of a model without stories, has a null ``story_no``.

    A border between stories that leaves less than ``min_area`` of a type on one side of it (unless the whole type is smaller) makes a
    sliver. Then the two stories trade equal areas: a type that has just begun takes more of its story and
    the type before it moves up; a type with little left gives area up and the type behind it moves
    down. A trade is five times ``min_area``, or what halves of both stories allow, and is left out when that is a sliver too.
    """
    types = with_interval(space_types, "type_order", "floor_area", "space_type", block=block).select("model_id", "space_type", "lo", "hi")
    own = F.greatest(F.coalesce("story_area", F.lit(0.0)), F.lit(0.0))
    placed = with_interval(stories, "story_no", "story_area", "story_no", block=block)
    above = stories.select("model_id", (F.col("story_no") - 1).alias("story_no"), own.alias("_next_area"))
    placed = placed.join(above, ["model_id", "story_no"], "left").select(
        "model_id", "story_no", "min_area", "_next_area", "lo", "hi", F.col("lo").alias("_s0"), F.col("hi").alias("_s1")
    )
    cell = _cells(types, placed)
    pieces = overlaps(types, placed, cell)
    trades = _trades(pieces, types)

    upper = trades.select("model_id", "story_no", F.col("_from").alias("_end"))
    lower = trades.select("model_id", (F.col("story_no") + 1).alias("story_no"), F.col("_to").alias("_begin"))
    core = placed.join(upper, ["model_id", "story_no"], "left").join(lower, ["model_id", "story_no"], "left").select(
        "model_id", "story_no", F.coalesce("_begin", "lo").alias("lo"), F.coalesce("_end", "hi").alias("hi")
    )
    swapped = trades.select(
        "model_id",
        F.inline(
            F.array(
                F.struct((F.col("story_no") + 1).alias("story_no"), F.col("_from").alias("lo"), F.col("_turn").alias("hi")),
                F.struct(F.col("story_no"), F.col("_turn").alias("lo"), F.col("_to").alias("hi")),
            )
        ),
    )
    tops = placed.groupBy("model_id").agg(F.max("hi").alias("_top"))
    rest = types.join(tops, "model_id", "left").select(
        "model_id", F.lit(None).cast(stories.schema["story_no"].dataType).alias("story_no"), "space_type",
        (F.col("hi") - F.greatest(F.col("lo"), F.coalesce("_top", F.lit(0.0)))).alias("area"),
    ).where(F.col("area") > TOLERANCE)
    held = overlaps(types, core.unionByName(swapped), cell).select("model_id", "story_no", "space_type", (F.col("hi") - F.col("lo")).alias("area"))
    whole = held.groupBy("model_id", "story_no", "space_type").agg(F.sum("area").alias("area"))
    return whole.unionByName(rest.select("model_id", "story_no", "space_type", "area"))
