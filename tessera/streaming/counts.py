"""Streaming forms of the frequency table and the cross-tabulation, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_frequency(stream: DataFrame, time: str, fields: list[str], window: str, late: str) -> DataFrame:
    """Counts of each combination in tumbling windows; rows later than ``late`` are left out, and state is dropped behind them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *fields).agg(F.count(F.lit(1)).alias("Counts")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *fields, "Counts")


def windowed_crosstab(stream: DataFrame, time: str, row: str, col: str, values: list, window: str, late: str) -> DataFrame:
    """A row for each window and row class, a count for each of ``values``, and ``Total``."""
    counts = [F.count_if(F.col(col) == v).alias(str(v)) for v in values]
    out = stream.withWatermark(time, late).groupBy(F.window(time, window), row).agg(*counts, F.count(F.lit(1)).alias("Total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), row, *[str(v) for v in values], "Total")
