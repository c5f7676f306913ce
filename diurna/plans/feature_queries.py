"""Queries of feature views, tasks, scalers, checks and score tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import argmax
from ..operators import features, learners, matrix, metrics, records
from ..sources import wearables
from . import bindings as b
from .learner_queries import _SCALED, FEATURES, _vectors
from .model_queries import _FIG, _MATRIX, _SCORES, _STATS, SEED, _counts, _hash48
from .record_queries import _IMP, _RECORDS, _importances, _records
from .signal_queries import _r, rounded

STATISTICS = ("median", "std", "cv", "stv7", "rolling_cv14", "range", "mean", "paper_hr_drop", "bedtime_regularity", "hourly", "state_code_3_fraction", "score", "valid_fraction", "first_epoch_day")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features named after event types and statistics, and those of the one-feature view."""
    types = b.table(spark, sf_dir, "events").select("event_type").distinct()
    modality = F.when(F.col("event_type").isin("view", "click"), "activity").when(F.col("event_type") == "error", "coupling").otherwise("sleep")
    rows = types.select("event_type", modality.alias("modality"), F.explode(F.array(*[F.lit(s) for s in STATISTICS])).alias("s"))
    rows = rows.withColumn("prefix", F.explode(F.array(F.lit(""), F.lit("v3__"))))
    family = F.when(F.col("s") == "score", "vendor").when(F.col("s") == "valid_fraction", "quality").when(F.col("s") == "first_epoch_day", "collection_context").otherwise("physiology")
    named = rows.select(F.concat("prefix", "modality", F.lit("__"), "event_type", F.lit("__"), "s").alias("feature"), "modality", family.alias("family"))
    own = spark.createDataFrame([(features.SINGLE[1], "activity", "physiology"), (features.COMPACT[5], "sleep", "physiology"), (features.COMPACT[12], "activity", "physiology")], named.schema)
    return named.unionByName(own)


def feature_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every view."""
    return features.view_features(_meta(spark, sf_dir))


def readable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).select("feature", features.readable(F.col("feature")).alias("readable"))


def task_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects and labels of the three tasks."""
    s = b.scores(spark, sf_dir).select("id", "y")
    parts = [features.task_rows(s, t).withColumn("task", F.lit(t)) for t in ("flat", "dem", "cn_mci")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def branch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).withColumn("side", F.col("name") % 2)
    return features.branch_candidates(r, "side", "name", "auc", (0, 1))


def sleep_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock figures of the span of each user's events on a day."""
    e = b.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject"), F.to_date("ts").alias("date")).agg(
        F.min("ts").cast("timestamp").alias("start"), F.max("ts").cast("timestamp").alias("end"), *[F.sum(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)).alias(t) for t in ("view", "click")], F.sum("value").alias("total")
    )
    clock = features.sleep_clock(F.col("start"), F.col("end"), F.col("view"), F.col("click"), F.col("total"))
    return rounded(e.select("subject", "date", *[c.alias(n) for n, c in clock.items()]))


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.matrix(spark, sf_dir).withColumn("subject", F.col("subject") % 50)


def window_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each subject's rows, by feature."""
    return rounded(features.subject_centres(_centres(spark, sf_dir)))


def log_scaled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed logarithms, scaled by their median and quartiles."""
    m = b.matrix(spark, sf_dir)
    logs = features.log_scale(matrix.fill(m, matrix.fit_statistics(m)).select(m.columns))
    return rounded(matrix.scale(logs, matrix.fit_statistics(logs), clip=30.0))


def quantile_scaled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal scores of places among the quantiles of four in five subjects."""
    m = b.matrix(spark, sf_dir)
    filled = matrix.fill(m, matrix.fit_statistics(m)).select(m.columns)
    return rounded(features.quantile_scale(filled, features.fit_quantiles(filled.filter("subject % 5 <> 0"))))


def weighted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.scores(spark, sf_dir).withColumn("predicted", argmax([F.col(f"p{k}") for k in range(3)]))
    out = metrics.weighted_means(metrics.report(metrics.confusion(s)))
    return rounded(out.select("support_0", "support_1", "support_2", "weighted_precision", "weighted_recall", "weighted_f1"))


def drop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.drop_summary(_importances(spark, sf_dir), ["feature"], "value"))


def seed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three shifted copies of the scores, as of models of three seeds."""
    s = b.scores(spark, sf_dir)
    each = s.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    each = each.select("id", "seed", *[F.when(F.col("seed") == 0, F.col(f"p{k}")).when(F.col("seed") == 1, F.col(f"p{(k + 1) % 3}")).otherwise(F.pow(F.col(f"p{k}"), 2)).alias(f"p{k}") for k in range(3)])
    return rounded(features.seed_mean(each, "id", "seed", ["p0", "p1", "p2"]))


def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight score tables, some alike, those that differ from all before."""
    s = b.scores(spark, sf_dir).select("id", "p0", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("model"))
    value = F.round(F.col("p0") * (1 + F.col("model") % 3), 6) + F.when(F.col("model") == 6, 1e-10).otherwise(0.0)
    kept = records.distinct_predictions(s.select("id", "model", value.alias("v")), "model", "id", "v", spark.createDataFrame([(i,) for i in (3, 0, 1, 2, 4, 5, 6, 7)], "model int"))
    return spark.createDataFrame([(i, m) for i, m in enumerate(kept)], "place int, model int")


def correlation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty features of which no two correlate by 0.05 or more."""
    m = b.matrix(spark, sf_dir)
    chosen = matrix.correlation_filter(matrix.fill(m, matrix.fit_statistics(m)), FEATURES, 0.05, 20)
    return spark.createDataFrame([(i, f) for i, f in enumerate(chosen)], "place int, feature int")


def greedy_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members picked from four score tables, in order."""
    s = b.scores(spark, sf_dir)
    each = s.withColumn("model", F.explode(F.array(*[F.lit(m) for m in range(4)])))
    shift = lambda k: F.when(F.col("model") == 0, F.col(f"p{k}")).when(F.col("model") == 1, F.col(f"p{(k + 1) % 3}")).when(F.col("model") == 2, F.when(F.col("y") == k, F.lit(0.3)).otherwise(0.0) + F.col(f"p{k}")).otherwise(F.lit(1 / 3))
    rows = each.select(F.col("id").alias("subject"), "y", "model", *[shift(k).alias(f"p{k}") for k in range(3)])
    chosen = learners.greedy_ensemble(rows, [0, 1, 2, 3])
    return spark.createDataFrame([(i, m) for i, m in enumerate(chosen)], "step int, model int")


def matrix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fingerprint(b.matrix(spark, sf_dir))


def jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies with noise until classes are equal."""
    from pyspark.ml.functions import vector_to_array

    data = _vectors(spark, sf_dir).select("subject", "y", vector_to_array("features").alias("values"))
    out = features.jitter(data, SEED)
    return out.select("y", "parent", "i", F.transform("values", lambda x: F.round(x, 6)).alias("values"))


def oversampled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows between near cases, a row for each value."""
    out = learners.oversample(_vectors(spark, sf_dir), SEED)
    return rounded(out.select("y", "parent", "neighbour", F.posexplode("features").alias("feature", "value")))


def _raw_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw rows of a sleep recording: texts, some of them unusable."""
    r = wearables.RECORDINGS["sleep"]
    k, start = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.pmod(F.col("o_orderkey") * 7919, F.lit(86400)))
    duration = F.when(k % 13 == 0, F.lit("-1")).when(k % 17 == 0, F.lit("n/a")).otherwise(F.floor("o_totalprice").cast("long").cast("string"))
    values = {wearables.SUBJECT: F.concat(F.lit(" C"), F.col("o_custkey").cast("string"), F.lit("@X.org ")), "sleep_duration": duration}
    values[r.times[0]] = F.date_format(start, "yyyy-MM-dd HH:mm:ss")
    values[r.times[1]] = F.when(k % 31 == 0, F.lit("junk")).otherwise(F.date_format(start + F.expr("interval 8 hours"), "yyyy-MM-dd HH:mm:ss"))
    return b.table(spark, sf_dir, "orders").select(*[values.get(c, F.lit(None).cast("string")).alias(c) for c in wearables.columns(r)])


def recording_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean days of a sleep recording: the longest sleep of a date, and how many there were."""
    days, _ = wearables.subject_days(_raw_sleep(spark, sf_dir), wearables.RECORDINGS["sleep"])
    return rounded(days.select("subject", "date", "sleep__duration", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.col("episode_count").cast("long").alias("episode_count")))


def recording_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning that recording left out."""
    return wearables.subject_days(_raw_sleep(spark, sf_dir), wearables.RECORDINGS["sleep"])[1]


def recording_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock phases of that recording's days."""
    r = wearables.RECORDINGS["sleep"]
    days, _ = wearables.subject_days(_raw_sleep(spark, sf_dir), r)
    out = wearables.daily_metrics(days, r)
    return rounded(out.select("subject", "date", *[f"sleep__{n}_{f}" for n in ("bedtime", "wake") for f in ("sin", "cos")], "sleep__hr_valid_fraction", "sleep__state_length"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_views, readable_names, task_membership, branch_candidates, sleep_clock, window_centres, log_scaled_matrix, quantile_scaled_matrix, weighted_report,
        drop_summary, seed_mean, distinct_models, correlation_filter, greedy_ensemble, matrix_fingerprint, jittered, oversampled_values,
        recording_days, recording_audit, recording_phases,
    )
}

_META = f"""
t AS (SELECT DISTINCT event_type FROM events),
n AS (
  SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 'activity' WHEN event_type = 'error' THEN 'coupling' ELSE 'sleep' END AS modality, s, prefix
  FROM t, unnest({list(STATISTICS)}) x(s), unnest(['', 'v3__']) p(prefix)),
meta AS (
  SELECT prefix || modality || '__' || event_type || '__' || s AS feature, modality,
    CASE s WHEN 'score' THEN 'vendor' WHEN 'valid_fraction' THEN 'quality' WHEN 'first_epoch_day' THEN 'collection_context' ELSE 'physiology' END AS family FROM n
  UNION ALL SELECT * FROM (VALUES ('activity__low__extra_std', 'activity', 'physiology'), ('v3__sleep__paper_hr_drop_ratio__rolling_cv7', 'sleep', 'physiology'), ('activity__hourly_profile_stability', 'activity', 'physiology')))"""
_VARIES = "regexp_matches(feature, '__(std|cv|mad|iqr|rmssd|moving_range|stv[0-9]+|rolling_cv[0-9]+|rolling_range[0-9]+|range|bin_variance4)($|__)')"
_VIEWS = {
    "all": "true", "activity": "modality = 'activity'", "sleep": "modality = 'sleep'", "no_coupling": "modality <> 'coupling'", "physiology": "family = 'physiology'",
    "no_quality": "family <> 'quality'", "no_vendor": "family <> 'vendor'", "unscored": "family NOT IN ('quality', 'vendor')", "no_context": "family <> 'collection_context'",
    "context_only": "family = 'collection_context'", "temporal": "feature[:4] = 'v3__'", "legacy": "feature[:4] <> 'v3__' AND family <> 'collection_context'",
    "variability": _VARIES, "activity_variability": f"{_VARIES} AND modality = 'activity'", "paper_sleep": "feature[:11] = 'v3__sleep__'", "hr_drop": "contains(feature, 'paper_hr_')",
    "circadian": "regexp_matches(feature, 'cosinor|regularity|midpoint|bedtime|wake_|hourly|high10|low5')",
    "compact": "feature IN ('v3__sleep__paper_hr_drop_ratio__rolling_cv7', 'activity__hourly_profile_stability')", "dem_single": "feature = 'activity__low__extra_std'",
}
_LAB = "CASE WHEN label <= 5 THEN 0 WHEN label <= 8 THEN 1 ELSE 2 END"

ORACLE_SQL = {
    "feature_views": f"WITH {_META} " + " UNION ALL ".join(f"SELECT '{v}' AS view, feature FROM meta WHERE {w}" for v, w in _VIEWS.items()),
    "readable_names": f"WITH {_META} SELECT feature, replace(feature, 'state_code_3', 'state_3_low_intensity_activity') AS readable FROM meta",
    "task_membership": f"""
WITH s AS (SELECT vec_id AS id, {_LAB} AS y FROM embeddings)
SELECT id, y, 'flat' AS task FROM s UNION ALL SELECT id, CASE WHEN y = 2 THEN 1 ELSE 0 END, 'dem' FROM s UNION ALL SELECT id, y, 'cn_mci' FROM s WHERE y <> 2""",
    "branch_candidates": f"""
WITH {_RECORDS}, k AS (SELECT name, name % 2 AS side, row_number() OVER (PARTITION BY name % 2 ORDER BY round(auc, 10) DESC, name) AS i FROM r)
SELECT x.name AS first, z.name AS second FROM k x, k z WHERE x.side = 0 AND z.side = 1 AND x.i <= 10 AND z.i <= 10""",
    "sleep_clock": f"""
WITH e AS (
  SELECT user_id AS subject, CAST(ts AS DATE) AS d, min(ts) AS s, max(ts) AS e, sum(CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0 END) AS nrem, sum(value) AS total FROM events GROUP BY ALL),
h AS (SELECT *, floor(epoch(s)) AS a, floor(epoch(e)) AS z FROM e),
c AS (SELECT *, (a % 86400) / 3600.0::DOUBLE AS bed, (z % 86400) / 3600.0::DOUBLE AS wake, ((a + floor((z - a) / 2)) % 86400) / 3600.0::DOUBLE AS mid FROM h)
SELECT subject, CAST(d AS VARCHAR) AS date, {_r("CASE WHEN bed < 12 THEN bed + 24 ELSE bed END", "bedtime_noon_unwrapped")}, {_r("wake", "wake_hour")}, {_r("(z - a) / 3600.0::DOUBLE", "interval_hours")},
  {_r("sin(mid * pi() / 12)", "midpoint_sin")}, {_r("cos(mid * pi() / 12)", "midpoint_cos")}, {_r("CASE WHEN abs(total) > 1e-8 THEN nrem / total END", "nrem_fraction")} FROM c""",
    "window_centres": f"WITH {_MATRIX} SELECT subject % 50 AS subject, feature, {_r('avg(value)', 'value')} FROM m GROUP BY 1, 2",
    "log_scaled_matrix": f"""
WITH {_MATRIX}, g AS (SELECT subject, y, feature, sign(value) * ln(1 + abs(value)) AS value, fill FROM filled), s AS ({_STATS} FROM g GROUP BY feature)
SELECT subject, y, feature, {_r("greatest(-30, least(30, (value - center) / scale))", "value")} FROM g JOIN s USING (feature)""",
    "weighted_report": f"""
WITH {_SCORES}, c AS ({_counts("said")}), f AS (
  SELECT n00 + n01 + n02 AS s0, n10 + n11 + n12 AS s1, n20 + n21 + n22 AS s2, {", ".join(f"{_FIG[f'{n}_{k}']} AS {n}_{k}" for n in ("precision", "recall", "f1") for k in range(3))} FROM c)
SELECT s0 AS support_0, s1 AS support_1, s2 AS support_2, {", ".join(_r(f"(s0 * {n}_0 + s1 * {n}_1 + s2 * {n}_2) / (s0 + s1 + s2)::DOUBLE", f"weighted_{n}") for n in ("precision", "recall", "f1"))} FROM f""",
    "drop_summary": f"""
WITH {_IMP} SELECT feature, count(*) AS repeats, {_r("avg(value)", "mean")}, {_r("stddev_samp(value)", "sd")}, {_r("quantile_cont(value, 0.5)", "median")},
  {_r("quantile_cont(value, 0.05)", "q05")}, {_r("quantile_cont(value, 0.95)", "q95")} FROM i GROUP BY feature""",
    "seed_mean": f"WITH {_SCORES} SELECT id, " + ", ".join(_r(f"(p{k} + p{(k + 1) % 3} + p{k} * p{k}) / 3", f"p{k}") for k in range(3)) + " FROM said",
    "distinct_models": f"""
WITH RECURSIVE {_SCORES}, o AS (SELECT unnest([3, 0, 1, 2, 4, 5, 6, 7]) AS model, generate_subscripts([3, 0, 1, 2, 4, 5, 6, 7], 1) AS i),
v AS (SELECT id, model, i, round(p0 * (1 + model % 3), 6) + CASE WHEN model = 6 THEN 1e-10 ELSE 0 END AS v FROM said, o),
near AS (SELECT x.i AS a, z.i AS b FROM v x JOIN v z ON x.id = z.id AND x.i < z.i GROUP BY ALL HAVING max(abs(x.v - z.v)) <= 1e-8),
kept AS (
  SELECT 1 AS i, [1] AS ks UNION ALL
  SELECT i + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE b = i + 1 AND list_contains(ks, a)) THEN ks ELSE list_append(ks, i + 1) END FROM kept WHERE i < 8)
SELECT CAST(p - 1 AS INTEGER) AS place, o.model FROM (SELECT unnest(ks) AS k, generate_subscripts(ks, 1) AS p FROM kept WHERE i = 8) JOIN o ON o.i = k""",
    "correlation_filter": f"""
WITH RECURSIVE {_MATRIX}, r AS (
  SELECT x.feature AS a, z.feature AS b, abs(corr(x.value, z.value)) AS r FROM filled x JOIN filled z ON x.subject = z.subject AND x.feature < z.feature GROUP BY ALL),
high AS (SELECT a, b FROM r WHERE r >= 0.05),
kept AS (
  SELECT 0 AS i, [0] AS ks UNION ALL
  SELECT i + 1, CASE WHEN len(ks) >= 20 OR EXISTS (SELECT 1 FROM high WHERE b = i + 1 AND list_contains(ks, a)) THEN ks ELSE list_append(ks, i + 1) END FROM kept WHERE i < 63)
SELECT CAST(generate_subscripts(ks, 1) - 1 AS INTEGER) AS place, CAST(unnest(ks) AS INTEGER) AS feature FROM kept WHERE i = 63""",
    "oversampled_values": f"""
WITH {_SCALED}, d AS (
  SELECT p.subject, p.y, q.subject AS neighbour, sqrt(sum((p.value - q.value) * (p.value - q.value))) AS distance
  FROM x p JOIN x q ON p.y = q.y AND p.feature = q.feature AND p.subject <> q.subject GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY distance, neighbour) AS r FROM d),
near AS (SELECT subject, list(neighbour ORDER BY r) AS near FROM k WHERE r <= 5 GROUP BY subject),
u AS (SELECT DISTINCT subject, y FROM x), n AS (SELECT y, count(*) AS n FROM u GROUP BY y), l AS (SELECT y, n, (SELECT max(n) FROM n) - n AS lack FROM n),
g AS (SELECT y, n, unnest(range(1, lack + 1)) AS i FROM l),
h AS (SELECT y, i, {_hash48(f"'{SEED}:' || y || ':' || i")} % n + 1 AS rank, {_hash48(f"'{SEED + 1}:' || y || ':' || i")} AS p, {_hash48(f"'{SEED + 2}:' || y || ':' || i")} / 281474976710656.0::DOUBLE AS t FROM g),
o AS (SELECT subject, y, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || subject)) AS rank FROM u),
m2 AS (SELECT h.y, h.i, o.subject AS parent, near[CAST(p % len(near) AS INTEGER) + 1] AS neighbour, t FROM h JOIN o USING (y, rank) JOIN near ON near.subject = o.subject)
SELECT m2.y, parent, neighbour, CAST(a.feature AS INTEGER) AS feature, {_r("a.value + t * (c.value - a.value)", "value")}
FROM m2 JOIN x a ON a.subject = parent JOIN x c ON c.subject = neighbour AND c.feature = a.feature""",
}

_SLEEP = """
o AS (SELECT *, CAST(o_orderdate AS TIMESTAMP) + to_seconds((o_orderkey * 7919) % 86400) AS s FROM orders),
r AS (
  SELECT sha256('c' || o_custkey || '@x.org') AS subject, s, CASE WHEN o_orderkey % 31 <> 0 THEN s + INTERVAL 8 HOUR END AS e,
    CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL ELSE floor(o_totalprice)::DOUBLE END AS duration FROM o),
k AS (
  SELECT *, CAST(e AS DATE) AS d, row_number() OVER (PARTITION BY subject, CAST(e AS DATE) ORDER BY duration DESC NULLS LAST, s) AS i, count(*) OVER (PARTITION BY subject, CAST(e AS DATE)) AS n
  FROM r WHERE e IS NOT NULL)"""
ORACLE_SQL |= {
    "recording_days": f"""
WITH {_SLEEP} SELECT subject, CAST(d AS VARCHAR) AS date, {_r("duration", "sleep__duration")}, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, n AS episode_count FROM k WHERE i = 1""",
    "recording_audit": f"""
WITH {_SLEEP} SELECT (SELECT count(*) FROM r) AS input_rows, (SELECT count(*) FROM r WHERE e IS NULL) AS bad_dates, CAST(sum(n - 1) AS BIGINT) AS duplicate_subject_dates,
  count(*) AS kept_rows, count(DISTINCT subject) AS subjects, 'sleep' AS modality FROM k WHERE i = 1""",
    "recording_phases": f"""
WITH {_SLEEP}, c AS (SELECT *, 2 * pi() * (epoch(s) % 86400) / 86400 AS a, 2 * pi() * (epoch(e) % 86400) / 86400 AS z FROM k WHERE i = 1)
SELECT subject, CAST(d AS VARCHAR) AS date, {_r("sin(a)", "sleep__bedtime_sin")}, {_r("cos(a)", "sleep__bedtime_cos")}, {_r("sin(z)", "sleep__wake_sin")}, {_r("cos(z)", "sleep__wake_cos")},
  0.0::DOUBLE AS sleep__hr_valid_fraction, CAST(0 AS BIGINT) AS sleep__state_length FROM c""",
}
