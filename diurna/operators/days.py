"""Subject-day tables: roll-ups, deduplication, windows and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subject_days(events: DataFrame, subject: str, ts: str, value: str, order: str | None = None) -> DataFrame:
    """Events rolled up to ``subject, date`` with four daily metrics.

    A day's values are added up by ``order``, or else by their times, equal ones
    by value, so that sums have the same last bits however the rows are dealt.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order or ts).alias("t"), F.col(value).cast("double").alias("v")))
    days = events.groupBy(F.col(subject).alias("subject"), F.to_date(ts).alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events"),
        F.array_sort(F.collect_list(known)).alias("_values"),
        F.max(value).alias("max_value"),
    )
    total = F.when(F.size("_values") > 0, F.aggregate("_values", F.lit(0.0), lambda s, x: s + x["v"]))
    return days.select("subject", "date", "n_events", total.alias("sum_value"), (total / F.size("_values")).alias("mean_value"), "max_value")


def long_form(days: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("subject", "date")) -> DataFrame:
    """One row for each key and metric; the shape all summaries work on."""
    return days.unpivot([F.col(k) for k in keys], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: str | None = None) -> DataFrame:
    """The first row of each key in ``order``; ``count`` names the number before."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_place", F.row_number().over(w.orderBy(*order)))
    if count:
        out = out.withColumn(count, F.count(F.lit(1)).over(w))
    return out.filter("_place = 1").drop("_place")


def observed_window(frames: Sequence[DataFrame], days: int | None, least: int) -> list[DataFrame]:
    """Rows within ``days`` of a subject's first date in any frame.

    Only subjects with at least ``least`` distinct dates over all frames stay.
    """
    dates = frames[0].select("subject", "date")
    for f in frames[1:]:
        dates = dates.unionByName(f.select("subject", "date"))
    dates = dates.distinct().withColumn("first", F.min("date").over(Window.partitionBy("subject")))
    if days is not None:
        dates = dates.filter(F.datediff("date", "first") < days)
    kept = dates.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("subject"))).filter(F.col("n") >= least).select("subject", "date")
    return [f.join(kept, ["subject", "date"], "left_semi") for f in frames]


def calendar_windows(frames: Sequence[DataFrame], width: int, least: int) -> list[DataFrame]:
    """Frames with ``block``: windows of ``width`` days from a subject's first date.

    Windows of fewer than ``least`` observed dates over all frames are left
    out; a subject without any keeps all rows as block -1.
    """
    dates = frames[0].select("subject", "date")
    for f in frames[1:]:
        dates = dates.unionByName(f.select("subject", "date"))
    by = Window.partitionBy("subject")
    dates = dates.distinct().withColumn("block", F.floor(F.datediff("date", F.min("date").over(by)) / F.lit(width)).cast("int"))
    dates = dates.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("subject", "block")))
    dates = dates.withColumn("most", F.max("n").over(by))
    dates = dates.filter((F.col("n") >= least) | (F.col("most") < least))
    dates = dates.select("subject", "date", F.when(F.col("most") < least, F.lit(-1)).otherwise(F.col("block")).alias("block"))
    return [f.join(dates, ["subject", "date"]) for f in frames]
