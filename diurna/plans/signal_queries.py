"""Queries of the day, summary and sequence operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import divide, number
from ..operators import days, sequences, summaries
from . import bindings as b


#: Keeps exact halves off the rounding edge, where engines' last bits decide.
NUDGE = 3e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so engines' last bits don't matter; dates as texts."""

    def plain(c: str, t: str):
        if t == "double":
            return (F.round(F.col(c) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(c)
        return F.col(c).cast("string").alias(c) if t == "date" else F.col(c)

    return df.select(*[plain(c, t) for c, t in df.dtypes])


def subject_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and metric: quantiles, coverage; users of seven days or more."""
    (kept,) = days.observed_window([b.daily(spark, sf_dir)], None, 7)
    return rounded(summaries.quantiles(days.long_form(kept, b.METRICS)))


def subject_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.distribution(b.daily_long(spark, sf_dir)))


def consecutive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.consecutive_days(b.daily_long(spark, sf_dir)))


def calendar_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.moments(b.daily_long(spark, sf_dir)))


def calendar_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.calendar_dynamics(b.daily_long(spark, sf_dir)))


PAIRS = [("sum_value", "sum_value"), ("n_events", "mean_value")]


def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-day and next-day coupling of browsing and acting."""
    a, s = b.two_modalities(spark, sf_dir)
    out = [summaries.coupling(a, s, PAIRS, k).withColumn("shift", F.lit(k)) for k in (0, 1)]
    return rounded(out[0].unionByName(out[1]))


def observation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days within three weeks of a user's first, over two tables, seven at least."""
    a, s = days.observed_window(list(b.two_modalities(spark, sf_dir)), 21, 7)
    both = a.withColumn("modality", F.lit("a")).unionByName(s.withColumn("modality", F.lit("s")))
    return rounded(both.groupBy("subject", "modality").agg(F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first"), F.max("date").alias("last")))


def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians in 14-day windows from each user's own first date."""
    a, s = days.calendar_windows(list(b.two_modalities(spark, sf_dir)), 14, 7)
    both = a.withColumn("modality", F.lit("a")).unionByName(s.withColumn("modality", F.lit("s")))
    return rounded(both.groupBy("subject", "block", "modality").agg(F.count(F.lit(1)).alias("n_days"), F.median("sum_value").alias("median_sum")))


def collection_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.context(b.daily(spark, sf_dir)))


def first_order_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order for each customer and date: the dearest, then the least key."""
    o = b.table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    out = days.first_per_key(o, ["o_custkey", "date"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()], count="episode_count")
    return rounded(out).select("o_custkey", "date", "o_orderkey", "o_totalprice", "episode_count")


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of packed strings by position."""
    rows = b.packed(spark, sf_dir).select("subject", "date", sequences.parse_sequence(F.col("packed")).alias("seq"))
    return rounded(sequences.continuous_stats(rows.filter(F.size("seq") > 0), "seq").drop("seq"))


def state_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.state_stats(b.states(spark, sf_dir), "seq", [1, 2, 3, 4])
    return rounded(out.drop("seq", "valid_fraction", "length"))


def cosinor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequences.cosinor(b.samples(spark, sf_dir), ["subject"], "hour", "value", 24, 12))


def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-5 and high-10 hours of users' profiles over all days."""
    p = sequences.hour_profile(b.samples(spark, sf_dir), ["subject"], "hour", "value", 1)
    return rounded(sequences.low_high(p, ["subject"]))


def profile_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = b.samples(spark, sf_dir).groupBy("subject", "date", F.floor("hour").cast("int").alias("h")).agg(F.avg("value").alias("m"))
    return rounded(sequences.profile_stability(cells, ["subject"]))


def hour_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across-day mean and sd of each clock hour."""
    cells = b.samples(spark, sf_dir).groupBy("subject", "date", F.floor("hour").cast("int").alias("h")).agg(F.avg("value").alias("m"))
    return rounded(cells.groupBy("subject", "h").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std")))


def clock_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regularity of each user's first event of the day."""
    first = b.samples(spark, sf_dir).groupBy("subject", "date").agg(F.min("hour").alias("hour"))
    return rounded(summaries.resultant(first, "hour", ["subject"]))


def rate_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop features of packed strings, values of 0 or less missing."""
    rows = b.packed(spark, sf_dir).select(
        "subject", "date", sequences.parse_sequence(F.col("packed"), positive_only=True).alias("seq"), F.lit(7200.0).alias("nrem"), F.lit(10800.0).alias("total"), F.lit(22.5).alias("start")
    )
    return rounded(sequences.rate_drop(rows, ["subject", "date"], "seq", "nrem", "total", "start"))


def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all kinds as numbers, and guarded ratios."""
    o = b.table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("nan")).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit(" "), F.col("o_custkey"))).when(F.col("o_orderkey") % 5 == 2, F.concat(F.col("o_custkey"), F.lit("d"))).when(
        F.col("o_orderkey") % 5 == 3, F.concat(F.lit("-"), F.col("o_custkey"), F.lit(".5e1"))
    ).otherwise(F.lit("inf"))
    rows = o.select("o_orderkey", number(text).alias("x"), (F.col("o_custkey") % 3 - 1).cast("double").alias("d"))
    return rounded(rows.select("o_orderkey", "x", divide(F.col("x"), F.col("d")).alias("ratio")))


QUERIES = {
    f.__name__: f
    for f in (
        subject_day_summary, subject_distribution, consecutive_days, calendar_moments, calendar_dynamics, coupling,
        observation_window, calendar_windows, collection_context, first_order_of_day, packed_sequences, state_sequences,
        cosinor, hour_profile, profile_stability, hour_statistics, clock_regularity, rate_drop, lenient_numbers,
    )
}

_DAILY = """
daily AS (
  SELECT user_id AS subject, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n_events,
    sum(value) AS sum_value, avg(value) AS mean_value, max(value) AS max_value
  FROM events GROUP BY ALL)"""
_LONG = _DAILY + """,
long AS (
  SELECT subject, date, 'n_events' AS metric, n_events AS value FROM daily UNION ALL
  SELECT subject, date, 'sum_value', sum_value FROM daily UNION ALL
  SELECT subject, date, 'mean_value', mean_value FROM daily UNION ALL
  SELECT subject, date, 'max_value', max_value FROM daily)"""
_TWO = """
a AS (
  SELECT user_id AS subject, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n_events, sum(value) AS sum_value, avg(value) AS mean_value
  FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
s AS (
  SELECT user_id AS subject, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n_events, sum(value) AS sum_value, avg(value) AS mean_value
  FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY ALL),
dates AS (SELECT subject, date FROM a UNION SELECT subject, date FROM s)"""
_SAMPLES = """
samples AS (
  SELECT user_id AS subject, CAST(ts AS DATE) AS date,
    hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE AS hour, value FROM events)"""
_PACKED = """
packed AS (
  SELECT user_id AS subject, CAST(ts AS DATE) AS date,
    list(CASE WHEN event_id % 7 = 3 THEN NULL ELSE CAST(floor(value * 100) AS DOUBLE) END ORDER BY event_id) AS raw
  FROM events GROUP BY ALL),
-- empty tokens at the end go
trimmed AS (
  SELECT subject, date, raw[1 : coalesce(list_max([CASE WHEN raw[i] IS NOT NULL THEN i END for i in range(1, len(raw) + 1)]), 0)] AS seq FROM packed)"""


def _corr(x: str, y: str, least: int) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return (
        f"CASE WHEN count(*) {both} >= {least} AND min({x}) {both} < max({x}) {both} AND min({y}) {both} < max({y}) {both} "
        f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) {both} * stddev_pop({y}) {both}) END"
    )


def _slope(y: str, x: str, least: int = 4) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"CASE WHEN count(*) {both} >= {least} AND min({x}) {both} < max({x}) {both} THEN regr_slope({y}, {x}) END"


def _r(expression: str, name: str) -> str:
    return f"round(({expression}) + {NUDGE}, 6) + 0.0 AS {name}"


def _rolling() -> tuple[str, str]:
    inner, outer = [], []
    for w in (7, 14, 28):
        frame = f"OVER (PARTITION BY subject, metric ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        enough = f"count(value) {frame} >= {max(4, w // 2)}"
        inner += [
            f"CASE WHEN {enough} THEN stddev_samp(value) {frame} END AS sd{w}",
            f"CASE WHEN {enough} THEN avg(value) {frame} END AS mean{w}",
            f"CASE WHEN {enough} THEN max(value) {frame} - min(value) {frame} END AS range{w}",
        ]
        outer += [_r(f"avg(sd{w})", f"stv{w}"), _r(f"avg(CASE WHEN abs(mean{w}) > 1e-8 THEN sd{w} / abs(mean{w}) END)", f"rolling_cv{w}"), _r(f"avg(range{w})", f"rolling_range{w}")]
    return ", ".join(inner), ", ".join(outer)


_INNER, _OUTER = _rolling()

ORACLE_SQL = {
    "subject_day_summary": f"""
WITH {_LONG}, kept AS (SELECT subject FROM daily GROUP BY subject HAVING count(*) >= 7)
SELECT subject, metric, {_r("quantile_cont(value, 0.5)", "median")}, {_r("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)", "iqr")},
  {_r("quantile_cont(value, 0.1)", "p10")}, {_r("quantile_cont(value, 0.9)", "p90")},
  {_r("1 - count(value) / count(*)::DOUBLE", "missing_fraction")}, count(*) AS n_days, date_diff('day', min(date), max(date)) + 1 AS span_days,
  {_r("count(*) / (date_diff('day', min(date), max(date)) + 1)::DOUBLE", "coverage")}
FROM long SEMI JOIN kept USING (subject) GROUP BY subject, metric""",
    "subject_distribution": f"""
WITH {_LONG}, mid AS (SELECT subject, metric, median(value) AS m FROM long GROUP BY ALL)
SELECT subject, metric, {_r("avg(value)", "mean")}, {_r("stddev_pop(value)", "std")}, {_r("median(abs(value - m))", "mad")},
  {_r('''CASE WHEN count(value) FILTER (WHERE isodow(date) >= 6) >= 2 AND count(value) FILTER (WHERE isodow(date) < 6) >= 2
    THEN avg(value) FILTER (WHERE isodow(date) >= 6) - avg(value) FILTER (WHERE isodow(date) < 6) END''', "weekend_delta")},
  {_r("CASE WHEN abs(avg(value)) > 1e-6 THEN stddev_pop(value) / abs(avg(value)) END", "cv")}
FROM long JOIN mid USING (subject, metric) GROUP BY subject, metric""",
    "consecutive_days": f"""
WITH {_LONG}, n AS (
  SELECT *, lag(value) OVER w AS l, date_diff('day', lag(date) OVER w, date) AS gap,
    CAST(date_diff('day', min(date) OVER (PARTITION BY subject, metric), date) AS DOUBLE) AS t
  FROM long WINDOW w AS (PARTITION BY subject, metric ORDER BY date)),
p AS (SELECT *, CASE WHEN gap = 1 THEN l END AS x, CASE WHEN gap = 1 THEN value END AS y FROM n)
SELECT subject, metric, {_r("sqrt(avg((y - x) * (y - x)))", "day_rmssd")}, {_r(_slope("value", "t"), "trend_per_day")}, {_r(_corr("x", "y", 4), "consecutive_lag1")}
FROM p GROUP BY subject, metric""",
    "calendar_moments": f"""
WITH {_LONG}, r AS (
  SELECT *, count(*) OVER w AS k, row_number() OVER (PARTITION BY subject, metric ORDER BY value) AS i, median(value) OVER w AS m
  FROM long WHERE value IS NOT NULL WINDOW w AS (PARTITION BY subject, metric)),
modes AS (
  SELECT subject, metric, arg_min(v, (-c, v)) AS mode
  FROM (SELECT subject, metric, round_even(value * 1000, 0) / 1000 AS v, count(*) AS c FROM r GROUP BY ALL) GROUP BY ALL)
SELECT subject, metric, count(*) AS n, {_r("avg(value)", "mean")}, {_r("coalesce(stddev_samp(value), 0)", "std")}, {_r("any_value(m)", "median")},
  {_r("avg(value) FILTER (WHERE i > floor(k * 0.1) AND i <= k - floor(k * 0.1))", "trimmed_mean")}, {_r("any_value(mode)", "mode")},
  {_r("min(value)", "minimum")}, {_r("max(value)", "maximum")}, {_r("max(value) - min(value)", "range")}, {_r("median(abs(value - m))", "mad")},
  {_r("CASE WHEN abs(avg(value)) > 1e-8 THEN coalesce(stddev_samp(value), 0) / abs(avg(value)) END", "cv")},
  {_r("quantile_cont(value, 0.05)", "q05")}, {_r("quantile_cont(value, 0.95)", "q95")},
  {_r("CASE WHEN count(*) >= 8 AND stddev_samp(value) > 1e-8 THEN skewness(value) END", "skew")},
  {_r("CASE WHEN count(*) >= 8 AND stddev_samp(value) > 1e-8 THEN kurtosis(value) END", "kurtosis")}
FROM r JOIN modes USING (subject, metric) GROUP BY subject, metric""",
    "calendar_dynamics": f"""
WITH {_LONG},
spine AS (
  SELECT subject, metric, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM long GROUP BY subject, metric),
c AS (SELECT subject, metric, date, value FROM spine LEFT JOIN long USING (subject, metric, date)),
r AS (
  SELECT *, lag(value) OVER o AS l, CAST(row_number() OVER o - 1 AS DOUBLE) AS t, count(*) OVER (PARTITION BY subject, metric) AS k, {_INNER}
  FROM c WINDOW o AS (PARTITION BY subject, metric ORDER BY date)),
g AS (
  SELECT subject, metric, {_r("sqrt(avg((value - l) * (value - l)))", "rmssd")}, {_r("avg(abs(value - l))", "moving_range")},
    {_r(_corr("l", "value", 4), "lag1")}, {_r(_slope("value", "t"), "trend")}, {_OUTER},
    avg(value) FILTER (WHERE least(floor(t * 4 / k), 3) = 0) AS b0, avg(value) FILTER (WHERE least(floor(t * 4 / k), 3) = 1) AS b1,
    avg(value) FILTER (WHERE least(floor(t * 4 / k), 3) = 2) AS b2, avg(value) FILTER (WHERE least(floor(t * 4 / k), 3) = 3) AS b3
  FROM r GROUP BY subject, metric)
SELECT * EXCLUDE (b0, b1, b2, b3),
  {_r("CASE WHEN b0 + b1 + b2 + b3 IS NOT NULL THEN list_aggregate([b0, b1, b2, b3], 'var_samp') END", "bin_variance4")},
  {_r("(abs(b1 - b0) + abs(b2 - b1) + abs(b3 - b2)) / 3", "bin_change4")}
FROM g""",
    "coupling": " UNION ALL ".join(
        f"""
SELECT a.subject, count(*) AS n_pairs, {_r(_corr("a.sum_value", "s.sum_value", 7), "sum_value__sum_value_corr")},
  {_r(_corr("a.n_events", "s.mean_value", 7), "n_events__mean_value_corr")}, {k} AS shift
FROM a JOIN s ON a.subject = s.subject AND a.date + {k} = s.date GROUP BY a.subject"""
        for k in (0, 1)
    ),
    "observation_window": f"""
WITH {_TWO}, d AS (SELECT *, min(date) OVER (PARTITION BY subject) AS f FROM dates),
w AS (SELECT subject, date, count(*) OVER (PARTITION BY subject) AS k FROM d WHERE date_diff('day', f, date) < 21),
kept AS (SELECT subject, date FROM w WHERE k >= 7),
u AS (SELECT subject, date, 'a' AS modality FROM a UNION ALL SELECT subject, date, 's' FROM s)
SELECT subject, modality, count(*) AS n_days, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM u SEMI JOIN kept USING (subject, date) GROUP BY ALL""",
    "calendar_windows": f"""
WITH {_TWO}, d AS (SELECT *, CAST(date_diff('day', min(date) OVER (PARTITION BY subject), date) // 14 AS INTEGER) AS block FROM dates),
k AS (SELECT *, count(*) OVER (PARTITION BY subject, block) AS k FROM d), m AS (SELECT *, max(k) OVER (PARTITION BY subject) AS most FROM k),
kept AS (SELECT subject, date, CASE WHEN most < 7 THEN -1 ELSE block END AS block FROM m WHERE k >= 7 OR most < 7),
u AS (SELECT subject, date, sum_value, 'a' AS modality FROM a UNION ALL SELECT subject, date, sum_value, 's' FROM s)
SELECT subject, block, modality, count(*) AS n_days, {_r("median(sum_value)", "median_sum")} FROM u JOIN kept USING (subject, date) GROUP BY ALL""",
    "collection_context": f"""
WITH {_DAILY}
SELECT subject, CAST(min(date - DATE '2000-01-01') AS DOUBLE) AS first_epochday, CAST(max(date - DATE '2000-01-01') AS DOUBLE) AS last_epochday,
  median(date - DATE '2000-01-01') AS median_epochday,
  {_r("avg(sin(2 * pi() * (dayofyear(date) - 1) / 365.25))", "season_sin")}, {_r("avg(cos(2 * pi() * (dayofyear(date) - 1) / 365.25))", "season_cos")},
  {_r("avg(CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE)", "weekend_fraction")}
FROM daily GROUP BY subject""",
    "first_order_of_day": """
SELECT o_custkey, date, o_orderkey, round(o_totalprice + 3e-10, 6) + 0.0 AS o_totalprice, episode_count FROM (
  SELECT *, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS episode_count,
    row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders)
WHERE place = 1""",
    "packed_sequences": f"""
WITH {_PACKED}, pos AS (SELECT subject, date, len(seq) AS n, unnest(seq) AS x, unnest(range(len(seq))) AS pos FROM trimmed WHERE len(seq) > 0),
p AS (SELECT *, lag(x) OVER (PARTITION BY subject, date ORDER BY pos) AS l FROM pos)
SELECT subject, CAST(date AS VARCHAR) AS date, {_r("avg(x)", "mean")}, {_r("stddev_pop(x)", "std")}, {_r("quantile_cont(x, 0.1)", "p10")}, {_r("quantile_cont(x, 0.9)", "p90")},
  {_r("sqrt(avg((x - l) * (x - l)))", "rmssd_adjacent")}, {_r(_corr("l", "x", 4), "lag1")},
  {_r("avg(x) FILTER (WHERE pos >= n - n // 3) - avg(x) FILTER (WHERE pos < n // 3)", "last_first_third")},
  {_r("count(x) / count(*)::DOUBLE", "valid_fraction")}, max(n) AS length
FROM p GROUP BY subject, date""",
    "state_sequences": f"""
WITH pos AS (
  SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 END AS s FROM events),
q AS (SELECT *, lag(s) OVER (PARTITION BY subject ORDER BY pos) AS l, pos - row_number() OVER (PARTITION BY subject, s ORDER BY pos) AS run FROM pos),
lengths AS (SELECT subject, s, count(*) AS k FROM q WHERE s IS NOT NULL GROUP BY subject, s, run),
best AS (SELECT subject, s, max(k) AS longest FROM lengths GROUP BY ALL),
f AS (SELECT subject, s, count(*) / sum(count(*)) OVER (PARTITION BY subject) AS f FROM q WHERE s IS NOT NULL GROUP BY subject, s),
t AS (SELECT subject, avg(CASE WHEN s <> l THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (WHERE s IS NOT NULL AND l IS NOT NULL) AS transition_rate FROM q GROUP BY subject)
SELECT t.subject,
  {", ".join(_r(f"CASE WHEN count(f) > 0 THEN coalesce(max(f) FILTER (WHERE f.s = {s}), 0) END", f"code_{s}_fraction") for s in (1, 2, 3, 4))},
  {", ".join(f"CAST(CASE WHEN count(f) > 0 THEN coalesce(max(longest) FILTER (WHERE f.s = {s}), 0) * 5 END AS BIGINT) AS code_{s}_longest_minutes" for s in (1, 2, 3, 4))},
  {_r("-sum(f * ln(f))", "entropy")}, {_r("any_value(transition_rate)", "transition_rate")}
FROM t LEFT JOIN f USING (subject) LEFT JOIN best ON best.subject = f.subject AND best.s = f.s GROUP BY t.subject""",
    "cosinor": f"""
WITH {_SAMPLES}, x AS (SELECT subject, hour AS h, value AS y, cos(2 * pi() * hour / 24) AS c, sin(2 * pi() * hour / 24) AS s FROM samples WHERE value IS NOT NULL),
g AS (
  SELECT subject, count(*) AS n, count(DISTINCT floor(h)) AS k, avg(y) AS my, avg(c) AS mc, avg(s) AS ms, var_pop(c) AS cc, var_pop(s) AS ss,
    covar_pop(c, s) AS cs, covar_pop(c, y) AS cy, covar_pop(s, y) AS sy,
    avg(y) FILTER (WHERE h >= 8 AND h < 20) - avg(y) FILTER (WHERE h < 8 OR h >= 20) AS dn FROM x GROUP BY subject),
f AS (SELECT *, cc * ss - cs * cs AS det, n >= 24 AND k >= 12 AND cc * ss - cs * cs > 1e-12 AS ok FROM g),
e AS (SELECT *, CASE WHEN ok THEN (cy * ss - sy * cs) / det END AS b1, CASE WHEN ok THEN (sy * cc - cy * cs) / det END AS b2 FROM f),
a AS (SELECT *, my - b1 * mc - b2 * ms AS b0, sqrt(b1 * b1 + b2 * b2) AS amp FROM e)
SELECT subject, {_r("amp", "amplitude")}, {_r("CASE WHEN abs(b0) > 0 THEN amp / abs(b0) END", "relative_amplitude")},
  {_r("CASE WHEN amp > 0 THEN b1 / amp END", "phase_cos")}, {_r("CASE WHEN amp > 0 THEN b2 / amp END", "phase_sin")},
  {_r("CASE WHEN ok THEN dn END", "day_night_difference")} FROM a""",
    "hour_profile": f"""
WITH {_SAMPLES}, m AS (SELECT subject, CAST(floor(hour) AS INTEGER) AS h, avg(value) AS m FROM samples GROUP BY ALL),
spine AS (SELECT subject, unnest(range(48)) AS h FROM (SELECT DISTINCT subject FROM samples)),
p AS (SELECT spine.subject, spine.h, m.m FROM spine LEFT JOIN m ON m.subject = spine.subject AND m.h = spine.h % 24),
r AS (
  SELECT subject, h, CASE WHEN count(m) OVER a = 5 THEN avg(m) OVER a END AS x, CASE WHEN count(m) OVER b = 10 THEN avg(m) OVER b END AS y FROM p
  WINDOW a AS (PARTITION BY subject ORDER BY h ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), b AS (PARTITION BY subject ORDER BY h ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
g AS (SELECT subject, min(x) AS l, max(y) AS u FROM r WHERE h < 24 GROUP BY subject)
SELECT subject, {_r("l", "low5")}, {_r("u", "high10")}, {_r("CASE WHEN u + l > 0 THEN (u - l) / (u + l) END", "relative_high10_low5")} FROM g""",
    "profile_stability": f"""
WITH {_SAMPLES}, cells AS (SELECT subject, date, floor(hour) AS h, avg(value) AS m FROM samples GROUP BY ALL),
a AS (SELECT *, avg(m) OVER (PARTITION BY subject, h) AS p, avg(m) OVER (PARTITION BY subject) AS o FROM cells)
SELECT subject, {_r("CASE WHEN count(*) > 48 AND sum((m - o) * (m - o)) > 0 THEN sum((p - o) * (p - o)) / sum((m - o) * (m - o)) END", "stability")} FROM a GROUP BY subject""",
    "hour_statistics": f"""
WITH {_SAMPLES}, cells AS (SELECT subject, date, CAST(floor(hour) AS INTEGER) AS h, avg(value) AS m FROM samples GROUP BY ALL)
SELECT subject, h, {_r("avg(m)", "mean")}, {_r("stddev_pop(m)", "std")} FROM cells GROUP BY subject, h""",
    "clock_regularity": f"""
WITH {_SAMPLES}, first AS (SELECT subject, date, min(hour) AS hour FROM samples GROUP BY ALL)
SELECT subject, {_r("sqrt(power(avg(sin(2 * pi() * hour / 24)), 2) + power(avg(cos(2 * pi() * hour / 24)), 2))", "regularity")} FROM first GROUP BY subject""",
    "rate_drop": f"""
WITH {_PACKED}, q AS (SELECT subject, date, [CASE WHEN x > 0 THEN x END for x in seq] AS seq FROM trimmed),
v AS (SELECT *, [x for x in seq if x IS NOT NULL] AS v, [x for x in seq[1:3] if x IS NOT NULL] AS f FROM q),
m AS (
  SELECT *, len(v) >= 4 AS ok, CASE WHEN len(f) >= 2 THEN list_avg(f) END AS base, CASE WHEN len(v) >= 4 THEN list_min(v) END AS low,
    CASE WHEN len(v) >= 4 THEN list_aggregate(v, 'quantile_cont', 0.05) END AS low05, CASE WHEN len(v) >= 4 THEN list_aggregate(v, 'quantile_cont', 0.95) END AS high95,
    CASE WHEN len(v) >= 4 THEN list_avg(v[1:3]) END AS legacy, CAST(list_position(seq, list_min(v)) - 1 AS DOUBLE) AS place FROM v),
s AS (
  SELECT subject, date, regr_slope(y, p) AS slope FROM (SELECT subject, date, unnest(seq) AS y, unnest(range(len(seq))) * 5 / 60.0::DOUBLE AS p FROM m WHERE len(v) >= 12) GROUP BY ALL)
SELECT m.subject, CAST(m.date AS VARCHAR) AS date,
  {_r("CASE WHEN abs(base) > 1e-8 THEN (base - low) / base END", "drop_ratio")}, {_r("CASE WHEN abs(base) > 1e-8 THEN (base - low05) / base END", "drop05_ratio")},
  {_r("(base - low) / 2", "drop_per_nrem_hour")}, {_r("(base - low05) / 2", "drop05_per_nrem_hour")}, {_r("(base - low) / 3", "drop_per_sleep_hour")}, {_r("(base - low05) / 3", "drop05_per_sleep_hour")},
  {_r("CASE WHEN abs(legacy) > 1e-8 THEN (legacy - low) / legacy END", "drop_firstvalid_ratio")}, {_r("base", "baseline")}, {_r("high95 - low05", "robust_range")}, {_r("slope", "slope_per_hour")},
  {_r("CASE WHEN len(v) >= 12 THEN place / greatest(len(seq) - 1, 1) END", "min_relative_time")},
  {_r("CASE WHEN ok THEN sin(((22.5 + place * 5 / 60.0::DOUBLE) % 24) * pi() / 12) END", "min_clock_sin")}, {_r("CASE WHEN ok THEN cos(((22.5 + place * 5 / 60.0::DOUBLE) % 24) * pi() / 12) END", "min_clock_cos")}
FROM m LEFT JOIN s USING (subject, date)""",
    "lenient_numbers": """
WITH t AS (
  SELECT o_orderkey, CAST(o_custkey % 3 - 1 AS DOUBLE) AS d,
    CASE o_orderkey % 5 WHEN 1 THEN CAST(o_custkey AS DOUBLE) WHEN 3 THEN -CAST(o_custkey || '.5e1' AS DOUBLE) END AS x FROM orders)
SELECT o_orderkey, round(x + 3e-10, 6) + 0.0 AS x, round(CASE WHEN d > 0 THEN x / d END + 3e-10, 6) + 0.0 AS ratio FROM t""",
}
ORACLE_SQL["coupling"] = f"WITH {_TWO} " + ORACLE_SQL["coupling"]
