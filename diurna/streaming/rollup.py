"""Streaming forms of the daily roll-up and of deduplication.

An extension: the batch operators are the reference for their results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_rollup(events: DataFrame, subject: str, ts: str, value: str, late: str = "1 day") -> DataFrame:
    """Daily metrics of each subject; a day is final once the watermark passes it."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day").alias("w"), F.col(subject).alias("subject"))
        .agg(F.count(F.lit(1)).cast("double").alias("n_events"), F.sum(value).alias("sum_value"), F.max(value).alias("max_value"))
        .select("subject", F.to_date("w.start").alias("date"), "n_events", "sum_value", "max_value")
    )


def first_events(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Events without repeats of ``keys`` within the watermark's delay."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
