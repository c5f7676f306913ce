"""Shapes of the general tables that the signal operators run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import days

METRICS = ["n_events", "sum_value", "mean_value", "max_value"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and day."""
    return days.subject_days(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")


def daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days.long_form(daily(spark, sf_dir), METRICS)


def two_modalities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Browsing and acting days of users, as two tables of one row a day."""
    e = table(spark, sf_dir, "events")
    browse = F.col("event_type").isin("view", "click")
    return tuple(days.subject_days(e.filter(c), "user_id", "ts", "value", "event_id") for c in (browse, ~browse))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their clock hour, by user and day."""
    e = table(spark, sf_dir, "events")
    hour = F.hour("ts") + F.minute("ts") / 60.0 + F.second("ts").cast("double") / 3600.0
    return e.select(F.col("user_id").alias("subject"), F.to_date("ts").alias("date"), hour.alias("hour"), "value")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packed string for each user and day: event values in cents, in order.

    Every seventh event is an empty token, and strings end in two slashes.
    """
    e = table(spark, sf_dir, "events")
    token = F.when(F.col("event_id") % 7 == 3, F.lit("")).otherwise(F.floor(F.col("value") * 100).cast("long").cast("string"))
    grouped = e.groupBy(F.col("user_id").alias("subject"), F.to_date("ts").alias("date")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), token.alias("t")))).alias("l")
    )
    return grouped.select("subject", "date", F.concat(F.array_join(F.transform("l", lambda x: x["t"]), "/"), F.lit("//")).alias("packed"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user in order, ``subject, seq``: states 1 to 4; errors are none."""
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4)
    rows = e.groupBy(F.col("user_id").alias("subject")).agg(F.array_sort(F.collect_list(F.struct("event_id", code.cast("double").alias("x")))).alias("l"))
    return rows.select("subject", F.transform("l", lambda e: e["x"]).alias("seq"))


def class_of(label: str):
    """Classes 0, 1, 2 of embeddings by their label."""
    return F.when(F.col(label) <= 5, 0).when(F.col(label) <= 8, 1).otherwise(2)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores that sum to 1 and a class 0, 1, 2 for each embedding."""
    from ..functions.scalars import softmax

    e = table(spark, sf_dir, "embeddings")
    p = softmax([F.col("embedding")[i].cast("double") for i in range(3)])
    return e.select(F.col("vec_id").alias("id"), class_of("label").alias("y"), *[c.alias(f"p{i}") for i, c in enumerate(p)])


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in long form with a class; every 17th value is missing."""
    e = table(spark, sf_dir, "embeddings")
    long = e.select(F.col("vec_id").alias("subject"), class_of("label").alias("y"), F.posexplode("embedding").alias("feature", "v"))
    return long.select("subject", "y", "feature", F.when((F.col("subject") + F.col("feature")) % 17 != 0, F.col("v").cast("double")).alias("value"))
