"""Edges that arrive as a stream: the rules are row-wise, so they hold for streaming frames as they stand; counts by
category and window are kept with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshqa.operators.rules import flag


def flagged(stream: DataFrame, rules: dict[str, str]) -> DataFrame:
    return flag(stream, rules)


def counts_by_window(stream: DataFrame, time: str, category: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window start, category, n; rows later than `late` are left out, as their windows are closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), category).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), category, "n")
