"""Messages of many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom import constants as K


def relevant(
    log: DataFrame,
    channel_pattern: str,
    skip_messages: Sequence[str] = K.SKIP_MESSAGE_PARTS,
    skip_channels: Sequence[str] = K.SKIP_CHANNEL_PARTS,
) -> DataFrame:
    """Messages of matching channels without those known to say nothing."""
    keep = F.col("channel").rlike(channel_pattern)
    for part in skip_messages:
        keep = keep & ~F.contains("message", F.lit(part))
    for part in skip_channels:
        keep = keep & ~F.contains("channel", F.lit(part))
    return log.where(keep)


def classify(log: DataFrame, debug: bool = False) -> DataFrame:
    """Level and text to show; debug messages only on request."""
    level, message = F.col("level"), F.col("message")
    tagged = F.concat(F.lit("["), F.col("channel"), F.lit("] "), message)
    shown = log.withColumns(
        {
            "shown_as": F.when(level == "Info", "info").when(level == "Warn", "warning")
            .when(level == "Error", "error").when((level == "Debug") & F.lit(debug), "info"),
            "text": F.when(level.isin("Warn", "Error"), tagged)
            .when(level == "Debug", F.concat(F.lit("DEBUG - "), message)).otherwise(message),
        }
    )
    return shown.where(F.col("shown_as").isNotNull())


def count_levels(classified: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return classified.groupBy(*keys, "shown_as").agg(F.count(F.lit(1)).alias("n_messages"))
