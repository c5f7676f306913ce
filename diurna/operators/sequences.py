"""Packed intraday sequences: one string a day, positions kept."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import divide, guarded_slope, number, safe_ratio


def parse_sequence(c: Column, positive_only: bool = False) -> Column:
    """Tokens between slashes as doubles.

    Empty tokens at the end go, those inside stay as NULL; an empty-like text
    gives an empty array.  ``positive_only`` turns values of 0 or less to NULL.
    """
    text = F.trim(c)
    none = F.array().cast("array<double>")
    tokens = F.split(F.regexp_replace(text, r"(/\s*)+$", ""), "/")
    values = F.transform(tokens, lambda t: F.when(number(t) > 0, number(t)) if positive_only else number(t))
    empty = c.isNull() | text.isin("", "nan", "...", "None") | (F.regexp_replace(text, r"[/\s]", "") == "")
    return F.when(empty, none).otherwise(values)


#: What ``continuous_stats`` says of a sequence.
CONTINUOUS = ("mean", "std", "p10", "p90", "rmssd_adjacent", "lag1", "last_first_third", "valid_fraction", "length")


def continuous_stats(df: DataFrame, sequence: str, prefix: str = "") -> DataFrame:
    """``df`` with moments, order statistics and changes of each row's sequence (``CONTINUOUS``).

    All is done within the row, a batch at a time: no position becomes a row of
    its own and nothing is shuffled.  A null sequence counts as empty: length 0,
    valid fraction 0, all else null.
    """
    return _with_stats(df, sequence, [(f"{prefix}{c}", "long" if c == "length" else "double") for c in CONTINUOUS], _continuous)


def state_stats(df: DataFrame, sequence: str, states: Sequence[int], minutes: int = 5, prefix: str = "") -> DataFrame:
    """``df`` with share and longest run of each state, entropy, transition rate, valid fraction and length.

    Positions without a listed state break runs and have no transitions.
    Within the row, as ``continuous_stats``.
    """
    states = list(states)
    fields = [(f"code_{s}_fraction", "double") for s in states] + [(f"code_{s}_longest_minutes", "long") for s in states]
    fields += [("entropy", "double"), ("transition_rate", "double"), ("valid_fraction", "double"), ("length", "long")]
    return _with_stats(df, sequence, [(prefix + n, t) for n, t in fields], lambda row, pos, x, n: _states(row, pos, x, n, states, minutes))


def _with_stats(df: DataFrame, sequence: str, fields: list[tuple[str, str]], stats) -> DataFrame:
    """Columns by ``stats(row, position, value, lengths)``, which sees a batch's values one after another, NaN for null."""
    # columns go by position: names may hold dots
    at = df.columns.index(sequence)
    source = df.select(*[(F.col(f"`{c}`").cast("array<double>") if i == at else F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    new = [T.StructField(f"_new{i}", T.LongType() if t == "long" else T.DoubleType()) for i, (_, t) in enumerate(fields)]
    schema = T.StructType([*source.schema.fields, *new])

    def run(batches):
        for batch in batches:
            for part in _slices(batch, at):
                column = part.column(at)
                n = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                x = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                row = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out = stats(row, pos, x, n)
                arrays = [pa.array(np.where(np.isfinite(v), v, 0).astype(np.int64), pa.int64(), mask=~np.isfinite(v)) if t == "long" else pa.array(v, pa.float64(), mask=~np.isfinite(v)) for v, (_, t) in zip(out, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], schema.names)

    return source.mapInArrow(run, schema).toDF(*df.columns, *[n for n, _ in fields])


#: Values of sequences that a task looks at together.
VALUES = 1 << 20


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch cut by rows so that its sequences have ``VALUES`` values at most; a longer one stands alone."""
    ends = np.cumsum(batch.column(at).value_lengths().fill_null(0).to_numpy().astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + VALUES, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _mean(row: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """Mean of each row's values; NaN for none."""
    return np.bincount(row, x, rows) / np.bincount(row, minlength=rows)


def _continuous(row: np.ndarray, pos: np.ndarray, x: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    rows = len(n)
    some = ~np.isnan(x)
    r, v = row[some], x[some]
    count = np.bincount(r, minlength=rows)
    mean = _mean(r, v, rows)
    std = np.sqrt(_mean(r, (v - mean[r]) ** 2, rows))
    ordered = v[np.lexsort((v, r))]
    first = np.cumsum(count) - count

    def quantile(p: float) -> np.ndarray:
        place = (count - 1) * p
        low = np.clip(np.floor(place).astype(np.int64), 0, None)
        out = np.full(rows, np.nan)
        held = count > 0
        a = ordered[first[held] + low[held]]
        b = ordered[first[held] + np.minimum(low[held] + 1, count[held] - 1)]
        out[held] = a + (b - a) * (place[held] - low[held])
        return out

    pair = np.flatnonzero((row[1:] == row[:-1]) & some[1:] & some[:-1])
    pr, a, b = row[pair], x[pair], x[pair + 1]
    da, db = a - _mean(pr, a, rows)[pr], b - _mean(pr, b, rows)[pr]
    va, vb, cov = (_mean(pr, d, rows) for d in (da * da, db * db, da * db))
    spread = np.sqrt(va) * np.sqrt(vb)
    lag = np.where((np.bincount(pr, minlength=rows) >= 4) & (spread > 0), cov / spread, np.nan)
    third = n // 3
    late, early = some & (pos >= (n - third)[row]), some & (pos < third[row])
    change = _mean(row[late], x[late], rows) - _mean(row[early], x[early], rows)
    return [mean, std, quantile(0.1), quantile(0.9), np.sqrt(_mean(pr, (b - a) ** 2, rows)), lag, change, np.where(n > 0, count / np.maximum(n, 1), 0.0), n.astype(float)]


def _states(row: np.ndarray, pos: np.ndarray, x: np.ndarray, n: np.ndarray, states: list[int], minutes: int) -> list[np.ndarray]:
    rows = len(n)
    known = np.isin(x, np.array(states, float))
    valid = np.bincount(row[known], minlength=rows).astype(float)
    share, longest = [], []
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (x[1:] != x[:-1])] if len(x) else np.zeros(0, bool))
    length = np.diff(starts, append=len(x))
    for s in states:
        share.append(np.where(valid > 0, np.bincount(row[x == s], minlength=rows) / valid, np.nan))
        most = np.zeros(rows)
        mine = x[starts] == s
        np.maximum.at(most, row[starts][mine], length[mine])
        longest.append(np.where(valid > 0, most * minutes, np.nan))
    entropy = -sum(np.where(f > 0, f * np.log(np.where(f > 0, f, 1)), 0) for f in share)
    pair = np.flatnonzero((row[1:] == row[:-1]) & known[1:] & known[:-1])
    moves = _mean(row[pair], (x[pair] != x[pair + 1]).astype(float), rows)
    return [*share, *longest, np.where(valid > 0, entropy, np.nan), moves, np.where(n > 0, valid / np.maximum(n, 1), 0.0), n.astype(float)]


def cosinor(samples: DataFrame, keys: list[str], hour: str, value: str, least: int, hours: int) -> DataFrame:
    """Fit mean + cos + sin of 24 hours in closed form; day minus night.

    Needs ``least`` values in ``hours`` different clock hours.
    """
    t = 2 * F.pi() * F.col(hour) / 24
    rows = samples.filter(F.col(value).isNotNull()).select(*keys, F.col(hour).alias("h"), F.col(value).alias("y"), F.cos(t).alias("c"), F.sin(t).alias("s"))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.floor("h")).alias("n_hours"),
        F.avg("y").alias("my"), F.avg("c").alias("mc"), F.avg("s").alias("ms"),
        F.var_pop("c").alias("cc"), F.var_pop("s").alias("ss"), F.covar_pop("c", "s").alias("cs"),
        F.covar_pop("c", "y").alias("cy"), F.covar_pop("s", "y").alias("sy"),
        (F.avg(F.when((F.col("h") >= 8) & (F.col("h") < 20), F.col("y"))) - F.avg(F.when((F.col("h") < 8) | (F.col("h") >= 20), F.col("y")))).alias("day_night_difference"),
    )
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    ok = (F.col("n") >= least) & (F.col("n_hours") >= hours) & (det > 1e-12)
    agg = agg.withColumn("b1", F.when(ok, (F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs")) / det)).withColumn("b2", F.when(ok, (F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs")) / det))
    agg = agg.withColumn("b0", F.col("my") - F.col("b1") * F.col("mc") - F.col("b2") * F.col("ms")).withColumn("amplitude", F.hypot("b1", "b2"))
    return agg.select(
        *keys,
        "amplitude",
        divide(F.col("amplitude"), F.abs("b0")).alias("relative_amplitude"),
        divide(F.col("b1"), F.col("amplitude")).alias("phase_cos"),
        divide(F.col("b2"), F.col("amplitude")).alias("phase_sin"),
        F.when(ok, F.col("day_night_difference")).alias("day_night_difference"),
    )


def hour_profile(samples: DataFrame, keys: list[str], hour: str, value: str, least: int) -> DataFrame:
    """Mean of each clock hour with ``least`` values: ``keys, h, m``; 24 rows a key."""
    means = samples.groupBy(*keys, F.floor(hour).cast("int").alias("h")).agg(F.when(F.count(value) >= least, F.avg(value)).alias("m"))
    spine = samples.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    return spine.join(means, [*keys, "h"], "left")


def low_high(profile: DataFrame, keys: list[str], low: int = 5, high: int = 10) -> DataFrame:
    """Least mean of ``low`` and greatest of ``high`` hours in a row round the clock.

    A stretch with a missing hour is skipped.
    """
    # the day is laid out twice, so stretches over midnight are rows in a row
    twice = profile.select(*keys, "m", F.explode(F.array(F.col("h"), F.col("h") + 24)).alias("h"))
    order = Window.partitionBy(*keys).orderBy("h")

    def stretch(n: int) -> Column:
        frame = order.rowsBetween(0, n - 1)
        return F.when(F.count("m").over(frame) == n, F.avg("m").over(frame))

    rolled = twice.withColumns({"a": stretch(low), "b": stretch(high)}).filter("h < 24")
    agg = rolled.groupBy(*keys).agg(F.min("a").alias("low5"), F.max("b").alias("high10"))
    return agg.withColumn("relative_high10_low5", divide(F.col("high10") - F.col("low5"), F.col("high10") + F.col("low5")))


def profile_stability(profile: DataFrame, keys: list[str], least: int = 48) -> DataFrame:
    """Share of variance over days and hours that the mean hour profile explains."""
    by = profile.filter(F.col("m").isNotNull()).groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), F.var_pop("m").alias("v"))
    w = Window.partitionBy(*keys)
    by = by.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    d = F.col("mean") - F.col("all")
    agg = by.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * d * d).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    total = F.col("between") + F.col("within")
    return agg.select(*keys, F.when((F.col("n") > least) & (total > 0), F.col("between") / total).alias("stability"))


def rate_drop(df: DataFrame, keys: list[str], sequence: str, nrem_seconds: str, total_seconds: str, start: str) -> DataFrame:
    """How far a night's heart rate falls below its first minutes, thirteen ways."""
    seq = F.col(sequence)
    base = df.select(*keys, seq.alias("seq"), (F.col(nrem_seconds) / 3600).alias("nrem"), (F.col(total_seconds) / 3600).alias("total"), F.col(start).alias("start"))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    base = base.withColumns({"v": some(F.col("seq")), "f": some(F.slice("seq", 1, 3))})
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))

    def q(p: float) -> Column:
        s, at = F.sort_array("v"), (F.size("v") - 1) * F.lit(p)
        lo = F.floor(at).cast("int")
        a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size("v") - 1))
        return a + (b - a) * (at - lo)

    enough = F.size("v") >= 4
    rows = base.select(
        *keys, "seq", "v", "nrem", "total", "start",
        F.when(F.size("f") >= 2, mean(F.col("f"))).alias("base"),
        F.when(enough, F.array_min("v")).alias("low"),
        F.when(enough, q(0.05)).alias("low05"),
        F.when(enough, q(0.95)).alias("high95"),
        F.when(enough, mean(F.slice("v", 1, 3))).alias("legacy"),
    )
    place = (F.array_position("seq", F.array_min("v")) - 1).cast("double")
    long = F.size("v") >= 12
    slopes = rows.filter(long).select(*keys, F.posexplode("seq").alias("p", "y")).groupBy(*keys).agg(guarded_slope(F.col("y"), F.col("p") * 5 / 60.0, 2).alias("slope"))
    clock = F.pmod(F.col("start") + place * 5 / 60.0, F.lit(24.0))
    out = {}
    for name, d in (("ratio", F.col("base")), ("per_nrem_hour", F.col("nrem")), ("per_sleep_hour", F.col("total"))):
        out[f"drop_{name}"] = safe_ratio(F.col("base") - F.col("low"), d)
        out[f"drop05_{name}"] = safe_ratio(F.col("base") - F.col("low05"), d)
    out["drop_firstvalid_ratio"] = safe_ratio(F.col("legacy") - F.col("low"), F.col("legacy"))
    out["baseline"] = F.col("base")
    out["robust_range"] = F.col("high95") - F.col("low05")
    out["slope_per_hour"] = F.col("slope")
    out["min_relative_time"] = F.when(long, place / F.greatest(F.size("seq") - 1, F.lit(1)))
    out["min_clock_sin"] = F.when(enough, F.sin(clock * F.pi() / 12))
    out["min_clock_cos"] = F.when(enough, F.cos(clock * F.pi() / 12))
    return rows.join(slopes, keys, "left").select(*keys, *[c.alias(n) for n, c in out.items()])
