"""Summaries of long ``subject, date, metric, value`` tables, by subject and metric.

One shuffle by (subject, metric) serves a summary's windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import divide, guarded_corr, guarded_slope, safe_ratio

KEYS = ["subject", "metric"]


def quantiles(long: DataFrame) -> DataFrame:
    """Median, inter-quartile range, p10, p90, missing share, days, span, coverage."""
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    span = F.datediff(F.max("date"), F.min("date")) + 1
    agg = long.groupBy(*KEYS).agg(
        q.alias("q"),
        (1 - F.count("value") / F.count(F.lit(1))).alias("missing_fraction"),
        F.count(F.lit(1)).alias("n_days"),
        span.cast("long").alias("span_days"),
    )
    return agg.select(
        *KEYS,
        F.col("q")[2].alias("median"),
        (F.col("q")[3] - F.col("q")[1]).alias("iqr"),
        F.col("q")[0].alias("p10"),
        F.col("q")[4].alias("p90"),
        "missing_fraction",
        "n_days",
        "span_days",
        divide(F.col("n_days"), F.col("span_days")).alias("coverage"),
    )


def distribution(long: DataFrame) -> DataFrame:
    """Mean, population sd, median absolute deviation, CV, weekend minus weekday."""
    by = Window.partitionBy(*KEYS)
    rows = long.withColumn("_mid", F.median("value").over(by))
    weekend = F.weekday("date") >= 5
    on, off = F.when(weekend, F.col("value")), F.when(~weekend, F.col("value"))
    agg = rows.groupBy(*KEYS).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.median(F.abs(F.col("value") - F.col("_mid"))).alias("mad"),
        F.when((F.count(on) >= 2) & (F.count(off) >= 2), F.avg(on) - F.avg(off)).alias("weekend_delta"),
    )
    return agg.withColumn("cv", F.when(F.abs("mean") > 1e-6, F.col("std") / F.abs("mean")))


def consecutive_days(long: DataFrame) -> DataFrame:
    """RMSSD and lag-1 correlation of neighbouring rows one day apart, and the trend.

    Neighbours are rows before nulls are dropped; a gap is never bridged.
    """
    by = Window.partitionBy(*KEYS).orderBy("date")
    rows = long.withColumns({
        "_last": F.lag("value").over(by),
        "_gap": F.datediff("date", F.lag("date").over(by)),
        "_t": F.datediff("date", F.min("date").over(Window.partitionBy(*KEYS))).cast("double"),
    })
    near = F.col("_gap") == 1
    a, b = F.when(near, F.col("_last")), F.when(near, F.col("value"))
    return rows.groupBy(*KEYS).agg(
        F.sqrt(F.avg((b - a) * (b - a))).alias("day_rmssd"),
        guarded_slope(F.col("value"), F.col("_t")).alias("trend_per_day"),
        guarded_corr(a, b, 4).alias("consecutive_lag1"),
    )


def calendar(long: DataFrame) -> DataFrame:
    """Rows for every date from a series' first to its last; new ones without value."""
    spine = long.groupBy(*KEYS).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    spine = spine.select(*KEYS, F.explode(F.sequence("a", "b")).alias("date"))
    return spine.join(long, [*KEYS, "date"], "left")


def moments(long: DataFrame) -> DataFrame:
    """Mean, sample sd, order statistics, trimmed mean, mode, corrected skew and kurtosis."""
    by = Window.partitionBy(*KEYS)
    rows = long.filter(F.col("value").isNotNull())
    rows = rows.withColumns({
        "_mid": F.median("value").over(by),
        "_n": F.count(F.lit(1)).over(by),
        "_i": F.row_number().over(by.orderBy("value")),
    })
    cut = F.floor(F.col("_n") * 0.1)
    inner = (F.col("_i") > cut) & (F.col("_i") <= F.col("_n") - cut)
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.95)))
    agg = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.first("_mid").alias("median"),
        F.avg(F.when(inner, F.col("value"))).alias("trimmed_mean"),
        F.expr("mode(rint(value * 1000) / 1000, true)").alias("mode"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.median(F.abs(F.col("value") - F.col("_mid"))).alias("mad"),
        q.alias("q"),
        F.skewness("value").alias("g1"),
        F.kurtosis("value").alias("g2"),
    )
    n = F.col("n").cast("double")
    ok = (F.col("n") >= 8) & (F.col("std") > 1e-8)
    return agg.select(
        *KEYS, "n", "mean", "std", "median", "trimmed_mean", "mode", "minimum", "maximum",
        (F.col("maximum") - F.col("minimum")).alias("range"),
        "mad",
        safe_ratio(F.col("std"), F.abs("mean")).alias("cv"),
        F.col("q")[0].alias("q05"),
        F.col("q")[1].alias("q95"),
        F.when(ok, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(ok, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
    )


def calendar_dynamics(long: DataFrame, widths: tuple[int, ...] = (7, 14, 28)) -> DataFrame:
    """Day-to-day change, trend, four-part trajectory and rolling spread on the calendar."""
    by = Window.partitionBy(*KEYS)
    order = by.orderBy("date")
    rows = calendar(long).withColumns({
        "_last": F.lag("value").over(order),
        "_t": (F.row_number().over(order) - 1).cast("double"),
        "_n": F.count(F.lit(1)).over(by),
    })
    rows = rows.withColumn("_bin", F.least(F.floor(F.col("_t") * 4 / F.col("_n")).cast("int"), F.lit(3)))
    rolled: dict[str, Column] = {}
    for w in widths:
        frame = order.rowsBetween(1 - w, 0)
        enough = F.count("value").over(frame) >= max(4, w // 2)
        sd, mean = F.when(enough, F.stddev_samp("value").over(frame)), F.avg("value").over(frame)
        rolled[f"_sd{w}"] = sd
        rolled[f"_cv{w}"] = F.when(F.abs(mean) > 1e-8, sd / F.abs(mean))
        rolled[f"_range{w}"] = F.when(enough, F.max("value").over(frame) - F.min("value").over(frame))
    rows = rows.withColumns(rolled)
    delta = F.col("value") - F.col("_last")
    bins = [F.avg(F.when(F.col("_bin") == i, F.col("value"))) for i in range(4)]
    agg = rows.groupBy(*KEYS).agg(
        F.sqrt(F.avg(delta * delta)).alias("rmssd"),
        F.avg(F.abs(delta)).alias("moving_range"),
        guarded_corr(F.col("_last"), F.col("value"), 4).alias("lag1"),
        guarded_slope(F.col("value"), F.col("_t")).alias("trend"),
        *[b.alias(f"_b{i}") for i, b in enumerate(bins)],
        *[F.avg(f"_{k}{w}").alias(f"{name}{w}") for w in widths for k, name in (("sd", "stv"), ("cv", "rolling_cv"), ("range", "rolling_range"))],
    )
    b = [F.col(f"_b{i}") for i in range(4)]
    full = b[0].isNotNull() & b[1].isNotNull() & b[2].isNotNull() & b[3].isNotNull()
    mid = (b[0] + b[1] + b[2] + b[3]) / 4
    variance = sum(((x - mid) * (x - mid) for x in b[1:]), (b[0] - mid) * (b[0] - mid)) / 3
    change = (F.abs(b[1] - b[0]) + F.abs(b[2] - b[1]) + F.abs(b[3] - b[2])) / 3
    return agg.withColumn("bin_variance4", F.when(full, variance)).withColumn("bin_change4", F.when(full, change)).drop(*[f"_b{i}" for i in range(4)])


def coupling(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]], shift: int, least: int = 7) -> DataFrame:
    """Pairs of days of one subject and guarded correlations across two tables.

    ``a`` of day d meets ``b`` of day d + ``shift``; both have one row a day.
    """
    joined = a.withColumn("date", F.date_add("date", shift)).alias("a").join(b.alias("b"), ["subject", "date"])
    return joined.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        *[guarded_corr(F.col(f"a.{x}"), F.col(f"b.{y}"), least).alias(f"{x}__{y}_corr") for x, y in pairs],
    )


def context(days: DataFrame, epoch: str = "2000-01-01") -> DataFrame:
    """When a subject was observed: epoch days, season, share of weekend days."""
    day = F.datediff("date", F.lit(epoch).cast("date"))
    phase = 2 * F.pi() * (F.dayofyear("date") - 1) / 365.25
    return days.groupBy("subject").agg(
        F.min(day).cast("double").alias("first_epochday"),
        F.max(day).cast("double").alias("last_epochday"),
        F.median(day).alias("median_epochday"),
        F.avg(F.sin(phase)).alias("season_sin"),
        F.avg(F.cos(phase)).alias("season_cos"),
        F.avg((F.weekday("date") >= 5).cast("double")).alias("weekend_fraction"),
    )


def resultant(rows: DataFrame, hours: str, keys: list[str]) -> DataFrame:
    """Length of the mean direction of clock hours: 1 is perfectly regular."""
    angle = 2 * F.pi() * F.col(hours) / 24
    return rows.groupBy(*keys).agg(F.hypot(F.avg(F.sin(angle)), F.avg(F.cos(angle))).alias("regularity"))
