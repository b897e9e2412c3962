"""All combinations of two tables without a cross join on one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.session import shuffle_width


def _block(df: DataFrame, blocks: int):
    return F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).cast("int")


def pair_all(left: DataFrame, right: DataFrame, left_blocks: int | None = None, right_blocks: int = 4) -> DataFrame:
    """Every row of ``left`` with every row of ``right``.

    The work is cut into ``left_blocks x right_blocks`` tiles. A left row goes
    to one tile row and is copied along it, a right row to one tile column, and
    the two meet in an equi-join on the tile, so no side has to fit in one task.
    ``left_blocks`` defaults to the session's number of shuffle partitions, so
    there are tiles for all of them whatever the sizes; give the larger table as
    ``left``, the rows of the other one are copied more often.
    """
    left_blocks = left_blocks or shuffle_width(left.sparkSession)
    tiled_left = left.withColumns(
        {
            "_tile_row": _block(left, left_blocks),
            "_tile_col": F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1))),
        }
    )
    tiled_right = right.withColumns(
        {
            "_tile_col": _block(right, right_blocks),
            "_tile_row": F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1))),
        }
    )
    # Sizes are not known for unfolded rows, so neither side is offered for broadcast.
    return tiled_left.join(tiled_right.hint("merge"), ["_tile_row", "_tile_col"]).drop("_tile_row", "_tile_col")
