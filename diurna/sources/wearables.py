"""Ingest of wearable recordings: CSV of texts to clean subject-day tables.

Columns are texts; what they mean is in the catalog below, from which schemas,
expressions and feature metadata follow.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import partial
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clock_hours, divide, local_timestamp, number, subject_key
from ..operators import sequences
from .tables import read_by_name

# The numeric columns of each recording, without their prefix.
ACTIVITY_NUMBERS = (
    "average_met cal_active cal_total daily_movement high inactive inactivity_alerts low medium met_min_high met_min_inactive met_min_low "
    "met_min_medium non_wear rest score score_meet_daily_targets score_move_every_hour score_recovery_time score_stay_active "
    "score_training_frequency score_training_volume steps total"
).split()
SLEEP_NUMBERS = (
    "awake breath_average deep duration efficiency hr_average hr_lowest light onset_latency rem restless rmssd score score_alignment score_deep "
    "score_disturbances score_efficiency score_latency score_rem score_total temperature_delta temperature_deviation total"
).split()
#: Sleep columns in which 0 means missing.
ZERO_IS_MISSING = ("hr_average", "hr_lowest", "rmssd", "breath_average")
FORBIDDEN = ("mmse", "cognitivefunction")


@dataclass(frozen=True)
class Recording:
    modality: str
    numbers: Sequence[str]
    times: tuple[str, str]
    packed: dict[str, str]  # kind of sequence to column
    states: Sequence[int]
    day_is_end: bool


RECORDINGS = {
    "activity": Recording(
        "activity", ACTIVITY_NUMBERS, ("activity_day_start", "activity_day_end"),
        {"state": "CONVERT(activity_class_5min USING utf8)", "met": "CONVERT(activity_met_1min USING utf8)"}, tuple(range(6)), False,
    ),
    "sleep": Recording(
        "sleep", SLEEP_NUMBERS, ("sleep_bedtime_start", "sleep_bedtime_end"),
        {"hr": "CONVERT(sleep_hr_5min USING utf8)", "state": "CONVERT(sleep_hypnogram_5min USING utf8)", "hrv": "CONVERT(sleep_rmssd_5min USING utf8)"}, (1, 2, 3, 4), True,
    ),
}
SUBJECT = "EMAIL"


def columns(r: Recording) -> list[str]:
    return [SUBJECT, *(f"{r.modality}_{n}" for n in r.numbers), *r.times, *r.packed.values()]


def check_path(path: str) -> str:
    """The path, unless it names a source that must not be read."""
    if any(word in path.lower().replace("_", "") for word in FORBIDDEN):
        raise ValueError(f"forbidden source: {path}")
    return path


def read_recording(spark: SparkSession, path: str | Sequence[str], r: Recording) -> DataFrame:
    """The catalog's columns as texts, by the names in each file's header; a file that lacks one is an error."""
    return read_by_name(spark, [check_path(p) for p in ([path] if isinstance(path, str) else path)], columns(r))


def _clean(name: str, modality: str) -> Column:
    x = number(F.col(f"{modality}_{name}"))
    if "temperature" not in name:
        x = F.when(x >= 0, x)
    if modality == "sleep" and name in ZERO_IS_MISSING:
        x = F.when(x != 0, x)
    return x


def subject_days(raw: DataFrame, r: Recording, zone: str = "Asia/Seoul") -> tuple[DataFrame, DataFrame]:
    """Clean days, one row for each subject and date, and an audit row.

    A day is the local date of the start (activity) or end (sleep).  Rows
    without a date go; of several on a date the longest sleep stays, then the
    earliest start, then the first by a hash of the row, as files have no order
    of their own.  ``episode_count`` tells how many there were.
    """
    m = r.modality
    start, end = local_timestamp(F.col(r.times[0]), zone), local_timestamp(F.col(r.times[1]), zone)
    rows = raw.select(
        subject_key(F.col(SUBJECT)).alias("subject"),
        start.alias("start"),
        end.alias("end"),
        *[_clean(n, m).alias(f"{m}__{n}") for n in r.numbers],
        *[F.col(f"`{c}`").alias(f"packed_{k}") for k, c in r.packed.items()],
    )
    rows = rows.withColumn("date", F.to_date("end" if r.day_is_end else "start"))
    from ..operators.days import first_per_key

    order = [F.col("sleep__duration").desc_nulls_last()] if m == "sleep" else []
    order += [F.col("start").asc_nulls_last(), F.xxhash64(*rows.columns)]
    kept = first_per_key(rows.filter("date is not null"), ["subject", "date"], order, count="episode_count")
    audit = rows.groupBy().agg(F.count(F.lit(1)).alias("input_rows"), F.count(F.when(F.col("date").isNull(), F.lit(1))).alias("bad_dates")).join(
        F.broadcast(kept.agg(F.coalesce(F.sum(F.col("episode_count") - 1), F.lit(0)).alias("duplicate_subject_dates"), F.count(F.lit(1)).alias("kept_rows"), F.count_distinct("subject").alias("subjects")))
    )
    return kept, audit.withColumn("modality", F.lit(m))


def _sequence(kind: str) -> Column:
    """A packed sequence as numbers: rates of 0 or less and negative METs are missing."""
    seq = sequences.parse_sequence(F.col(f"packed_{kind}"), positive_only=kind in ("hr", "hrv"))
    return F.transform(seq, lambda x: F.when(x >= 0, x)) if kind == "met" else seq


def daily_metrics(days: DataFrame, r: Recording) -> DataFrame:
    """All daily metrics of a recording, wide: 61 of activity, 62 of sleep."""
    m, keys = r.modality, ["subject", "date"]
    out = days.select(*keys, "start", "end", *[f"{m}__{n}" for n in r.numbers], *[_sequence(k).alias(f"_{k}") for k in r.packed])
    # sequences are read within their row
    for kind in r.packed:
        stats = partial(sequences.state_stats, states=list(r.states)) if kind == "state" else sequences.continuous_stats
        out = stats(out, f"_{kind}", prefix=f"{m}__{kind}_").drop(f"_{kind}")
    derived: dict[str, Column] = {}
    if m == "activity":
        out = out.join(_clock_metrics(days), keys, "left")
        minutes = (F.unix_timestamp("end") - F.unix_timestamp("start")) / 60.0
        wear = F.when((F.abs(minutes - 1440) < 1) & F.col("activity__non_wear").between(0, 1440), 1440 - F.col("activity__non_wear"))
        out = out.withColumns({"activity__interval_minutes": minutes, "_wear": wear})
        derived = {
            "steps_per_wear_hour": divide(F.col("activity__steps"), F.col("_wear") / 60),
            "moderate_high_fraction": divide(F.col("activity__medium") + F.col("activity__high"), F.col("_wear")),
            "inactive_fraction": divide(F.col("activity__inactive"), F.col("_wear")),
        }
    else:
        out = out.withColumns({f"_{n}": clock_hours(F.col(t)) for t, n in (("start", "bedtime"), ("end", "wake"))})
        derived = {f"{n}_fraction": divide(F.col(f"sleep__{n}"), F.col("sleep__total")) for n in ("deep", "light", "rem")}
        derived |= {"awake_fraction": divide(F.col("sleep__awake"), F.col("sleep__duration")), "latency_fraction": divide(F.col("sleep__onset_latency"), F.col("sleep__duration"))}
        for n in ("bedtime", "wake"):
            derived |= {f"{n}_sin": F.sin(2 * F.pi() * F.col(f"_{n}") / 24), f"{n}_cos": F.cos(2 * F.pi() * F.col(f"_{n}") / 24)}
    out = out.withColumns({f"{m}__{k}": v for k, v in derived.items()})
    return out.drop("start", "end", "_wear", "_bedtime", "_wake")


def _met_samples(days: DataFrame) -> DataFrame:
    seq = sequences.parse_sequence(F.col("packed_met"))
    pos = days.select("subject", "date", clock_hours(F.col("start")).alias("at"), F.posexplode(seq).alias("pos", "x"))
    return pos.select("subject", "date", F.pmod(F.col("at") + F.col("pos") / 60.0, F.lit(24.0)).alias("hour"), F.when(F.col("x") >= 0, F.col("x")).alias("x"))


#: A day has a rhythm from so many minutes in so many hours, an hour from so many minutes.
DAY_MINUTES, DAY_HOURS, HOUR_MINUTES = 720, 18, 30


def _clock_metrics(days: DataFrame) -> DataFrame:
    keys = ["subject", "date"]
    s = _met_samples(days).filter("x is not null")
    rhythm = sequences.cosinor(s, keys, "hour", "x", DAY_MINUTES, DAY_HOURS)
    swing = sequences.low_high(hour_profiles(days), keys)
    named = rhythm.select(*keys, *[F.col(c).alias("activity__met_" + (c if c.startswith("day") else f"cosinor_{c}")) for c in rhythm.columns if c not in keys])
    return named.join(
        swing.select(*keys, F.col("relative_high10_low5").alias("activity__met_relative_high10_low5"), F.col("low5").alias("activity__met_low5_met"), F.col("high10").alias("activity__met_high10_met")),
        keys,
        "left",
    )


def hour_profiles(days: DataFrame) -> DataFrame:
    """Mean MET of each clock hour of days with a rhythm: ``subject, date, h, m``."""
    keys = ["subject", "date"]
    s = _met_samples(days).filter("x is not null")
    enough = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.floor("hour")).alias("k")).filter((F.col("n") >= DAY_MINUTES) & (F.col("k") >= DAY_HOURS))
    return sequences.hour_profile(s.join(enough.select(*keys), keys, "left_semi"), keys, "hour", "x", HOUR_MINUTES)


def metric_meta(names: Iterable[str]) -> list[tuple[str, str, str]]:
    """(metric, modality, family) of daily metrics, by their names."""
    out = []
    for n in names:
        quality = any(t in n for t in ("non_wear", "valid_fraction", "_length", "interval_minutes"))
        out.append((n, n.split("__")[0], "vendor" if "score" in n else "quality" if quality else "physiology"))
    return out


def read_labels(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``subject, label`` from label files, which must agree."""
    from ..operators.records import reconcile_labels

    tables = []
    for p in paths:
        raw = read_by_name(spark, check_path(p), ["SAMPLE_EMAIL", "DIAG_NM"])
        tables.append(raw.select(subject_key(F.col("SAMPLE_EMAIL")).alias("subject"), F.col("DIAG_NM").alias("label")))
    return reconcile_labels(tables, ["CN", "MCI", "DEM"])


def resolve_paths(root: str) -> dict[str, dict[str, str]]:
    """Files of both splits under ``root``, in either layout; all must exist."""
    base = Path(root)
    out: dict[str, dict[str, str]] = {}
    for split, folder, short in (("train", "1.Training", "train"), ("validation", "2.Validation", "val")):
        files = {}
        for kind, names in (("activity", ("1.Gait", "1.걸음걸이")), ("sleep", ("2.Sleep", "2.수면"))):
            options = [base / folder / source / n / f"{short}_{kind}.csv" for source in ("SourceData", "원천데이터") for n in names]
            found = next((p for p in options if p.exists()), None)
            if found is None:
                raise FileNotFoundError(f"none of {[str(p) for p in options]}")
            files[kind] = str(found)
        out[split] = files
    return out


def fingerprint(spark: SparkSession, paths: Sequence[str], settings: dict) -> str:
    """One digest of the files' contents and the settings."""
    files = spark.read.format("binaryFile").load([check_path(p) for p in paths])
    digests = sorted(r[0] for r in files.select(F.sha2("content", 256)).collect())  # one for each file
    return hashlib.sha256(json.dumps([digests, settings], sort_keys=True).encode()).hexdigest()


def inference_days(spark: SparkSession, activity: str | Sequence[str], sleep: str | Sequence[str], zone: str = "Asia/Seoul") -> tuple[DataFrame, DataFrame]:
    """Daily metrics of subjects without labels, and the days each was observed.

    The first has a row for each subject and date of either recording; the
    second ``subject, observed_days``.
    """
    both = []
    for name, path in (("activity", activity), ("sleep", sleep)):
        r = RECORDINGS[name]
        days, _ = subject_days(read_recording(spark, path, r), r, zone)
        both.append(daily_metrics(days, r))
    metrics = both[0].join(both[1], ["subject", "date"], "full")
    return metrics, metrics.groupBy("subject").agg(F.count_distinct("date").alias("observed_days"))


# Metrics whose change from day to day is summarised.
CHANGING = {
    "activity": ("steps", "average_met", "inactive", "met_cosinor_amplitude", "met_relative_high10_low5"),
    "sleep": ("total", "efficiency", "hr_average", "rmssd", "awake_fraction", "deep_fraction", "rem_fraction"),
}
# Metrics of a day that are held against those of a sleep.
COUPLED = (("steps", "total"), ("steps", "efficiency"), ("average_met", "rmssd"), ("inactive", "awake_fraction"))
_SPREAD = ("median", "iqr", "p10", "p90", "missing_fraction")
_CHANGE = ("day_rmssd", "trend_per_day", "consecutive_lag1")
_WAKE_DAYS = ((0, "same_wake_day"), (1, "next_wake_day"))


def _named(table: DataFrame, names: dict[str, Column]) -> DataFrame:
    """Columns of a table by subject as rows ``subject, feature, value``."""
    return table.select("subject", *[c.cast("double").alias(n) for n, c in names.items()]).unpivot([F.col("subject")], [F.col(f"`{n}`") for n in names], "feature", "value")


def _stacked(table: DataFrame, statistics: Sequence[str]) -> DataFrame:
    """Statistics by subject and metric as rows ``subject, feature, value``."""
    return table.select("subject", "metric", F.posexplode(F.array(*[F.col(x).cast("double") for x in statistics])).alias("i", "value")).select(
        "subject", F.concat("metric", F.lit("__"), F.get(F.array(*[F.lit(x) for x in statistics]), F.col("i"))).alias("feature"), "value"
    )


def subject_features(activity: DataFrame, sleep: DataFrame, least: int = 7, within: int | None = None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """All features of a subject's days, wide, as floats; and (feature, modality, family) of each.

    Both tables hold clean days, as ``subject_days`` gives them.  Subjects with
    fewer than ``least`` dates are left out.  One without days of a kind misses
    everything there: its missing fractions are 1, its counts 0.
    """
    from ..operators import days as d

    kept = dict(zip(("activity", "sleep"), d.observed_window([activity, sleep], within, least), strict=True))
    rows, meta, empty = subject_rows(kept, {m: daily_metrics(kept[m], RECORDINGS[m]) for m in kept})
    wide = rows.groupBy("subject").pivot("feature", [n for n, _, _ in meta]).agg(F.first("value"))
    return wide.select("subject", *[F.coalesce(F.col(f"`{n}`"), F.lit(empty.get(n))).cast("float").alias(n) for n, _, _ in meta]), meta


def subject_rows(kept: dict[str, DataFrame], metrics: dict[str, DataFrame]) -> tuple[DataFrame, list[tuple[str, str, str]], dict[str, float]]:
    """Features as rows ``subject, feature, value``; what each is; and its value where a row is absent.

    ``kept``: clean days by modality, ``metrics``: their daily metrics.
    """
    from ..operators import days as d
    from ..operators import summaries

    parts, meta, empty = [], [], {}
    for m, frame in metrics.items():
        names = [c for c in frame.columns if c not in ("subject", "date")]
        family = {n: f for n, _, f in metric_meta(names)}
        long = d.long_form(frame, names)
        parts.append(_stacked(summaries.quantiles(long), _SPREAD))
        meta += [(f"{n}__{s}", m, "quality" if s == "missing_fraction" else family[n]) for n in names for s in _SPREAD]
        empty |= {f"{n}__missing_fraction": 1.0 for n in names}
        span = F.datediff(F.max("date"), F.min("date")) + 1
        counts = frame.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), span.alias("span"))
        quality = {f"{m}__quality_n_days": F.col("n"), f"{m}__quality_span_days": F.col("span"), f"{m}__quality_coverage": F.col("n") / F.col("span")}
        parts.append(_named(counts, quality))
        meta += [(n, m, "quality") for n in quality]
        empty |= {f"{m}__quality_n_days": 0.0, f"{m}__quality_span_days": 0.0}
        changing = [f"{m}__{n}" for n in CHANGING[m]]
        parts.append(_stacked(summaries.consecutive_days(long.filter(F.col("metric").isin(changing))), _CHANGE))
        meta += [(f"{n}__{s}", m, "physiology") for n in changing for s in _CHANGE]
    parts.append(_named(sequences.profile_stability(hour_profiles(kept["activity"]), ["subject"]), {"activity__hourly_profile_stability": F.col("stability")}))
    meta.append(("activity__hourly_profile_stability", "activity", "physiology"))
    phases = {}
    for n in ("bedtime", "wake"):
        sin, cos = F.col(f"sleep__{n}_sin"), F.col(f"sleep__{n}_cos")
        both = sin.isNotNull() & cos.isNotNull()
        phases[f"sleep__{n}_regularity"] = F.hypot(F.avg(F.when(both, sin)), F.avg(F.when(both, cos)))
    parts.append(_named(metrics["sleep"].groupBy("subject").agg(*[c.alias(n) for n, c in phases.items()]), {n: F.col(n) for n in phases}))
    meta += [(n, "sleep", "physiology") for n in phases]
    for shift, title in _WAKE_DAYS:
        pairs = [(f"activity__{a}", f"sleep__{b}") for a, b in COUPLED]
        table = summaries.coupling(metrics["activity"], metrics["sleep"], pairs, shift)
        names = {f"coupling__{title}_n_pairs": F.col("n_pairs")}
        names |= {f"coupling__{title}__{a}__{b}_corr": F.col(f"activity__{a}__sleep__{b}_corr") for a, b in COUPLED}
        parts.append(_named(table, names))
        meta += [(n, "coupling", "quality" if n.endswith("n_pairs") else "physiology") for n in names]
        empty[f"coupling__{title}_n_pairs"] = 0.0
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows, meta, empty
