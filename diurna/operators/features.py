"""Feature tables: named views, tasks, names, checks, fingerprints, resampling audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clock_hours, finite, normal_quantile, safe_ratio, signed_log
from .folds import hash_int

# Statistics that tell how much a metric varies.
VARIABILITY = "std|cv|mad|iqr|rmssd|moving_range|stv[0-9]+|rolling_cv[0-9]+|rolling_range[0-9]+|range|bin_variance4"
# Parts of the names of clock features.
CIRCADIAN = "cosinor|regularity|midpoint|bedtime|wake_|hourly|high10|low5"
# The feature of the one-feature view, and its stand-in.
SINGLE = ("v3__activity__low__std", "activity__low__extra_std")
# The features of the compact view.
COMPACT = (
    "v3__activity__low__std",
    "v3__activity__steps__std",
    "v3__activity__inactive__std",
    "v3__activity__rest__mean",
    "v3__sleep__paper_hr_drop_ratio__std",
    "v3__sleep__paper_hr_drop_ratio__rolling_cv7",
    "v3__sleep__paper_hr_drop05_ratio__mad",
    "v3__sleep__paper_bedtime_noon_unwrapped__std",
    "v3__sleep__paper_wake_hour__std",
    "v3__sleep__efficiency__mad",
    "v3__sleep__total__stv7",
    "v3__sleep__rmssd__cv",
    "activity__hourly_profile_stability",
    "sleep__bedtime_regularity",
    "sleep__wake_regularity",
)
# What the codes of activity states mean.
STATES = ("non_wear", "rest", "inactive", "low_intensity_activity", "medium_intensity_activity", "high_intensity_activity")
#: Column names must not hold these.
FORBIDDEN = ("mmse", "diag", "label")


def views() -> dict[str, Column]:
    """Which features a view holds, by its name; over ``feature, modality, family``."""
    name, modality, family = F.col("feature"), F.col("modality"), F.col("family")
    temporal, context = name.startswith("v3__"), family == "collection_context"
    varies = name.rlike(f"__({VARIABILITY})($|__)")
    return {
        "all": F.lit(True),
        "activity": modality == "activity",
        "sleep": modality == "sleep",
        "no_coupling": modality != "coupling",
        "physiology": family == "physiology",
        "no_quality": family != "quality",
        "no_vendor": family != "vendor",
        "unscored": ~family.isin("quality", "vendor"),
        "no_context": ~context,
        "context_only": context,
        "temporal": temporal,
        "legacy": ~temporal & ~context,
        "variability": varies,
        "activity_variability": varies & (modality == "activity"),
        "paper_sleep": name.startswith("v3__sleep__"),
        "hr_drop": name.contains("paper_hr_"),
        "circadian": name.rlike(CIRCADIAN),
        "compact": name.isin(*COMPACT),
    }


def view_features(meta: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``view, feature`` for the named views (all by default); an unknown one is an error.

    ``dem_single`` has one feature, the first of ``SINGLE`` that is there.
    """
    known = views()
    names = [*known, "dem_single"] if names is None else list(names)
    if unknown := sorted(set(names) - {*known, "dem_single"}):
        raise ValueError(f"unknown views: {unknown}")
    fits = F.array_compact(F.array(*[F.when(known[n], F.lit(n)) for n in names if n in known]))
    out = meta.select(F.explode(fits).alias("view"), "feature")
    if "dem_single" in names:
        place = F.when(F.col("feature") == SINGLE[0], 0).otherwise(1)
        one = meta.filter(F.col("feature").isin(*SINGLE)).agg(F.min_by("feature", place).alias("feature")).filter("feature is not null")
        out = out.unionByName(one.select(F.lit("dem_single").alias("view"), "feature"))
    return out


def task_rows(rows: DataFrame, task: str, y: str = "y") -> DataFrame:
    """Rows and labels of a task: all three classes, the last against the rest, or the first two."""
    if task == "flat":
        return rows
    if task == "dem":
        return rows.withColumn(y, (F.col(y) == 2).cast("int"))
    if task == "cn_mci":
        return rows.filter(F.col(y) != 2)
    raise ValueError(f"unknown task: {task}")


def branch_candidates(records: DataFrame, branch: str, name: str, figure: str, pair: tuple, k: int = 10) -> DataFrame:
    """All pairs of the ``k`` best records of two branches: ``first, second``."""
    first, second = (
        records.filter(F.col(branch) == side).orderBy(F.round(figure, 10).desc(), name).limit(k).select(F.col(name).alias(to)) for side, to in zip(pair, ("first", "second"), strict=True)
    )
    return first.join(F.broadcast(second))  # k rows each


def readable(name: Column) -> Column:
    """A feature's name with state codes spelled out."""
    out = name
    for code, label in enumerate(STATES):
        out = F.replace(out, F.lit(f"state_code_{code}"), F.lit(f"state_{code}_{label}"))
    return out


def sleep_clock(start: Column, end: Column, deep: Column, light: Column, total: Column) -> dict[str, Column]:
    """Clock figures of a sleep: bedtime counted from noon, wake hour, hours, middle, NREM share."""
    bed = clock_hours(start)
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    middle = F.timestamp_seconds(F.unix_timestamp(start) + F.floor(seconds / 2))
    angle = clock_hours(middle) * F.pi() / 12
    return {
        "bedtime_noon_unwrapped": F.when(bed < 12, bed + 24).otherwise(bed),
        "wake_hour": clock_hours(end),
        "interval_hours": seconds / 3600.0,
        "midpoint_sin": F.sin(angle),
        "midpoint_cos": F.cos(angle),
        "nrem_fraction": safe_ratio(deep + light, total),
    }


# --- Checks -------------------------------------------------------------------


def check_names(columns: Sequence[str], forbidden: Sequence[str] = FORBIDDEN) -> list[str]:
    """The names, unless one holds a forbidden word."""
    bad = [c for c in columns if any(w in c.lower() for w in forbidden)]
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return list(columns)


def as_floats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as floats; NaN and the infinities become null."""
    return df.withColumns({c: finite(F.col(c)).cast("float") for c in columns})


def check_training(wide: DataFrame, features: Sequence[str], subject: str = "subject", y: str = "y", classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """The table, once it is fit to train on; else an error that says what is wrong.

    Feature names must be distinct and numeric, subjects distinct and not null,
    labels of the known classes, all of which occur, and no value infinite.
    """
    if len(set(features)) != len(features):
        raise ValueError("repeated features")
    wrong = [c for c in features if not isinstance(wide.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"not numeric: {wrong}")
    check_names(features)
    infinite = [F.count(F.when(F.abs(F.col(f"`{c}`").cast("double")) == float("inf"), F.lit(1))) for c in features]
    facts = wide.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(subject).alias("subjects"), F.count(F.when(~F.coalesce(F.col(y).isin(*classes), F.lit(False)), F.lit(1))).alias("strangers"),
        F.count_distinct(y).alias("classes"), sum(infinite, F.lit(0)).alias("infinite"),
    ).first()
    if facts["subjects"] != facts["rows"]:
        raise ValueError("subjects repeat or are null: aggregate to one row each first")
    if facts["strangers"] or facts["classes"] != len(classes):
        raise ValueError(f"labels must be of {list(classes)}, and all must occur")
    if facts["infinite"]:
        raise ValueError("infinite values")
    return wide


def complete_join(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Features with labels; a key without a label is an error when rows are read."""
    marked = labels.withColumn("_known", F.lit(True))
    out = features.join(marked, key, "left")
    lost = F.raise_error(F.concat(F.lit("no label for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(features.schema[key].dataType)
    return out.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(lost)).drop("_known")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One digest of all rows, whatever their order: ``n, digest``."""
    columns = sorted(df.columns) if columns is None else list(columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16, 31)]
    sums = df.select(*[h.alias(f"s{i}") for i, h in enumerate(halves)]).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(3)])
    return sums.select("n", F.sha2(F.concat_ws(":", F.lit(",".join(columns)), F.col("n").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(3)]), 256).alias("digest"))


def check_unchanged(df: DataFrame, digest: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table, unless its fingerprint differs from the one taken before."""
    if fingerprint(df, columns).first()["digest"] != digest:
        raise ValueError("the table changed since its fingerprint was taken")
    return df


# --- Centres, scalers, augmentation ---------------------------------------------


def subject_centres(long: DataFrame) -> DataFrame:
    """Mean of each subject's windows, by feature; infinite values are missing."""
    return long.groupBy("subject", "feature").agg(F.avg(finite(F.col("value"))).alias("value"))


def log_scale(filled: DataFrame) -> DataFrame:
    """Filled values as signed logarithms; scale them like others."""
    return filled.withColumn("value", signed_log(F.col("value")))


def fit_quantiles(filled: DataFrame, quantiles: int = 100) -> DataFrame:
    """Each feature's values at evenly spaced ranks, at most one for each value: ``feature, q``."""
    n = filled.groupBy("feature").agg(F.count("value").alias("n")).agg(F.min("n")).first()[0] or 1
    k = max(2, min(quantiles, int(n)))
    return filled.groupBy("feature").agg(F.percentile("value", F.array(*[F.lit(i / (k - 1)) for i in range(k)])).alias("q"))


def quantile_scale(filled: DataFrame, statistics: DataFrame, clip: float = 30.0) -> DataFrame:
    """Values as normal scores of their place among the training quantiles.

    Between two quantiles the place is linear; on a run of equal ones it is the
    run's middle; beyond the ends it is the end, 1e-7 from 0 or 1.
    """
    rows = filled.join(F.broadcast(statistics), "feature", "left")
    q, x = F.col("q"), F.col("value")
    last = F.size(q) - 1
    low, upto = F.size(F.filter(q, lambda v: v < x)), F.size(F.filter(q, lambda v: v <= x))
    left, right = F.get(q, low - 1), F.get(q, low)
    place = F.when(upto > low, (low + upto - 1) / 2.0).when(low == 0, F.lit(0.0)).when(low > last, last.cast("double")).otherwise(low - 1 + (x - left) / (right - left))
    p = F.when(x <= F.get(q, F.lit(0)), F.lit(0.0)).when(x >= F.get(q, last), F.lit(1.0)).otherwise(place / last)
    z = normal_quantile(F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7)))
    return rows.select(*[c for c in filled.columns if c != "value"], F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("value"))


def jitter(data: DataFrame, seed: int, spread: float = 0.03) -> DataFrame:
    """Copies with normal noise until classes are equal: ``y, parent, i, values``.

    ``data``: ``subject, y, values`` (an array).  Which case is copied and the
    noise are hashes.
    """
    from .folds import digest
    from .ranking import hash_rank

    n = data.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    lack = n.join(n.agg(F.max("n").alias("most"))).filter("n < most")  # a row for each class
    ranked = hash_rank(data.withColumn("_d", digest(F.lit(seed), F.col("subject"))), ["y"], "_d")
    draws = lack.select("y", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most") - F.col("n"))).alias("i"))
    draws = draws.select("y", "i", (hash_int(F.lit(seed), F.col("y"), F.col("i")) % F.col("n") + 1).alias("rank"))
    rows = draws.join(ranked.select("y", "rank", "subject", "values"), ["y", "rank"])

    def unit(salt: int, k: Column) -> Column:
        return (hash_int(F.lit(seed + salt), F.col("y"), F.col("i"), k) + F.lit(0.5)) / F.lit(float(1 << 48))

    noise = F.transform("values", lambda v, k: v + F.lit(spread) * F.sqrt(-2 * F.ln(unit(1, k))) * F.cos(2 * F.pi() * unit(2, k)))
    return rows.select("y", F.col("subject").alias("parent"), "i", noise.alias("values"))


def stray_parents(made: DataFrame, parents: Sequence[str], training: DataFrame) -> DataFrame:
    """Parents of synthetic rows that are no training subjects; none if all is well."""
    named = made.select(F.explode(F.array(*[F.col(p) for p in parents])).alias("subject")).distinct()
    return named.join(training.select("subject"), "subject", "left_anti")


# --- Scores -------------------------------------------------------------------


def seed_mean(scores: DataFrame, key: str, seed: str, columns: Sequence[str]) -> DataFrame:
    """Mean of the models of all seeds; a key that a seed lacks is an error when rows are read."""
    seeds = scores.select(seed).distinct().agg(F.count(F.lit(1)).alias("_seeds"))
    by = scores.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns], F.count_distinct(seed).alias("_n")).join(seeds)  # one row
    whole = F.when(F.col("_n") == F.col("_seeds"), F.col(columns[0])).otherwise(F.raise_error(F.concat(F.lit("seeds missing for "), F.col(key).cast("string"))).cast("double"))
    return by.withColumn(columns[0], whole).drop("_n", "_seeds")


def drop_summary(drops: DataFrame, by: Sequence[str], value: str = "drop") -> DataFrame:
    """Mean, sample deviation, median and outer twentieths of repeated drops."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = drops.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("q"), F.count(value).alias("repeats"))
    return out.select(*by, "repeats", "mean", "sd", F.col("q")[1].alias("median"), F.col("q")[0].alias("q05"), F.col("q")[2].alias("q95"))


def flattened(records: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Structs of figures as columns of their own, prefixed by the struct's name."""
    plain = [F.col(f"`{c}`") for c in records.columns if c not in parts]
    return records.select(*plain, *[F.col(f"`{p}`")[f.name].alias(f"{p}_{f.name}") for p in parts for f in records.schema[p].dataType])


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A result as files: ``csv`` with a header, ``json`` lines or ``parquet``."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(kind)
    writer = df.write.mode("errorifexists")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
