"""Session with the settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "diurna", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; other settings by keyword."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
