"""The wider subject tables: spread and hours of the day, and how days change.

With the features of ``wearables.subject_features`` they add up to 1,333 and
5,144 columns.  So many don't make a plan of aggregates: all figures are rows
``subject, feature, value`` by one grouping each, and only the features a model
asks for become columns (``widen``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clock_hours
from ..operators import days as d
from ..operators import features, sequences, summaries
from . import wearables as w

Meta = list[tuple[str, str, str]]
KEYS = ["subject", "date"]
_EXTRA = ("mean", "std", "mad", "cv", "weekend_delta")
_MOMENTS = ("mean", "std", "median", "trimmed_mean", "mode", "minimum", "maximum", "range", "mad", "cv", "skew", "kurtosis", "q05", "q95")
_DYNAMICS = ("rmssd", "moving_range", "lag1", "trend", "bin_variance4", "bin_change4", *(f"{s}{n}" for n in (7, 14, 28) for s in ("stv", "rolling_cv", "rolling_range")))
_CONTEXT = ("first_epochday", "last_epochday", "median_epochday", "season_sin", "season_cos", "weekend_fraction")
#: What ``rate_drop`` calls otherwise.
_NIGHT = {"baseline": "hr_baseline_first15min"}
_QUALITY = ("valid_fraction", "_length", "interval_minutes", "non_wear")


def _metrics(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in KEYS]


def night_metrics(days: DataFrame) -> DataFrame:
    """Twenty more metrics of a sleep: its drop in heart rate, its clock, and how many were recorded."""
    rows = days.select(
        *KEYS, "start", "end", "episode_count", *[f"sleep__{n}" for n in ("deep", "light", "total")],
        sequences.parse_sequence(F.col("packed_hr"), positive_only=True).alias("seq"),
        (F.col("sleep__deep") + F.col("sleep__light")).alias("nrem"),
        clock_hours(F.col("start")).alias("at"),
    )
    drop = sequences.rate_drop(rows, KEYS, "seq", "nrem", "sleep__total", "at")
    named = drop.select(*KEYS, *[F.col(c).alias("sleep__paper_" + _NIGHT.get(c, f"hr_{c}")) for c in drop.columns if c not in KEYS])
    clock = features.sleep_clock(F.col("start"), F.col("end"), F.col("sleep__deep"), F.col("sleep__light"), F.col("sleep__total"))
    other = rows.select(*KEYS, *[c.alias(f"sleep__paper_{n}") for n, c in clock.items()], F.col("episode_count").cast("double").alias("sleep__paper_episode_count"))
    return named.join(other, KEYS)


def _stacked(table: DataFrame, statistics: Sequence[str], named: str) -> DataFrame:
    """Statistics by subject and metric as rows; ``named`` is a format of metric and statistic."""
    each = F.posexplode(F.array(*[F.col(s).cast("double") for s in statistics])).alias("i", "value")
    return table.select("subject", "metric", each).select(
        "subject", F.format_string(named, F.col("metric"), F.get(F.array(*[F.lit(s) for s in statistics]), F.col("i"))).alias("feature"), "value"
    )


def spread_rows(metrics: dict[str, DataFrame], profiles: DataFrame) -> tuple[DataFrame, Meta]:
    """Five figures of each daily metric's spread, and mean and deviation of each clock hour.

    ``profiles``: ``subject, date, h, m``, the mean of an hour of a day.
    """
    parts, meta = [], []
    for m, frame in metrics.items():
        names = _metrics(frame)
        parts.append(_stacked(summaries.distribution(d.long_form(frame, names)), _EXTRA, "%s__extra_%s"))
        meta += [(f"{n}__extra_{s}", m, f) for n, _, f in w.metric_meta(names) for s in _EXTRA]
    hours = profiles.filter("m is not null").groupBy("subject", F.format_string("activity__hour_%02d", F.col("h")).alias("metric"))
    parts.append(_stacked(hours.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std")), ("mean", "std"), "%s__%s"))
    meta += [(f"activity__hour_{h:02d}__{s}", "activity", "physiology") for h in range(24) for s in ("mean", "std")]
    return _union(parts), meta


def temporal_rows(metrics: dict[str, DataFrame]) -> tuple[DataFrame, Meta]:
    """Moments and calendar changes of each daily metric, and when a subject was observed.

    Metrics that only tell how well a day was recorded are left out, but for
    the number of sleeps.
    """
    parts, meta = [], []
    for m, frame in metrics.items():
        names = [n for n in _metrics(frame) if not any(q in n for q in _QUALITY)]
        long = d.long_form(frame, names).withColumn("metric", F.concat(F.lit("v3__"), "metric"))
        parts += [_stacked(summaries.moments(long), _MOMENTS, "%s__%s"), _stacked(summaries.calendar_dynamics(long), _DYNAMICS, "%s__%s")]
        family = {n: "quality" if "episode_count" in n else f for n, _, f in w.metric_meta(names)}
        meta += [(f"v3__{n}__{s}", m, family[n]) for n in names for s in (*_MOMENTS, *_DYNAMICS)]
        context = summaries.context(frame.select(*KEYS))
        parts.append(context.unpivot(["subject"], list(_CONTEXT), "feature", "value").withColumn("feature", F.concat(F.lit(f"context__{m}__"), "feature")))
        meta += [(f"context__{m}__{s}", m, "collection_context") for s in _CONTEXT]
    return _union(parts), meta


def all_rows(activity: DataFrame, sleep: DataFrame, folder: str, least: int = 7, within: int | None = None) -> tuple[DataFrame, Meta]:
    """Every feature of clean days as rows ``subject, feature, value``; and what each is.

    The basic and the spread features come from days inside the observed
    window, the temporal ones from all days of the subjects that have one.  NaN
    and the infinities are null.  Absent rows of counts and missing fractions
    are made up; others mean a missing value.

    Days and daily metrics serve a dozen branches of the plan, so they are
    written to ``folder`` (which all machines share) and read from there.
    """

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    every = {"activity": activity, "sleep": sleep}
    inside = dict(zip(every, d.observed_window([activity, sleep], within, least), strict=True))
    kept = {m: written(frame, f"days_{m}") for m, frame in inside.items()}
    metrics = {m: written(w.daily_metrics(kept[m], w.RECORDINGS[m]), f"metrics_{m}") for m in kept}
    people = written(kept["activity"].select("subject").unionByName(kept["sleep"].select("subject")).distinct(), "subjects")
    base, base_meta, empty = w.subject_rows(kept, metrics)
    spread, spread_meta = spread_rows(metrics, w.hour_profiles(kept["activity"]))
    wanted, longer = kept, metrics
    if within is not None:
        wanted = {m: written(frame.join(people, "subject", "left_semi"), f"all_days_{m}") for m, frame in every.items()}
        longer = {m: written(w.daily_metrics(wanted[m], w.RECORDINGS[m]), f"all_metrics_{m}") for m in wanted}
    longer = longer | {"sleep": written(longer["sleep"].join(night_metrics(wanted["sleep"]), KEYS), "nights")}
    temporal, temporal_meta = temporal_rows(longer)
    made_up = people.select("subject", F.explode(F.create_map(*[x for n, v in empty.items() for x in (F.lit(n), F.lit(v))])).alias("feature", "made_up"))
    base = base.withColumn("made_up", F.lit(None).cast("double")).unionByName(made_up.withColumn("value", F.lit(None).cast("double")))
    base = base.groupBy("subject", "feature").agg(F.coalesce(F.max("value"), F.max("made_up")).alias("value"))
    rows = _union([base, spread, temporal])
    value = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")).cast("float")
    return rows.select("subject", "feature", value.alias("value")), base_meta + spread_meta + temporal_meta


def widen(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named features as columns; a subject without any of them has no row."""
    return rows.filter(F.col("feature").isin(list(names))).groupBy("subject").pivot("feature", list(names)).agg(F.first("value"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows
