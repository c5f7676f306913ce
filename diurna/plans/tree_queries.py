"""Queries of trees, their explanations and nearest-neighbour information, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, learners, matrix, trees
from . import bindings as b
from .learner_queries import FEATURES, _vectors
from .model_queries import _MATRIX, SEED
from .signal_queries import _r, rounded

D = len(FEATURES)
STRENGTH, LEAST = 5.0, 8


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their missing values kept."""
    e = b.table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") + i) % 17 != 0, v.cast("double")))
    return e.select(F.col("vec_id").alias("subject"), b.class_of("label").alias("y"), x.alias("x"))


def feature_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins that boosting cuts each feature into."""
    return rounded(trees.bins(_rows(spark, sf_dir)))


def _first_sums(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Tasks' sums at the roots of the first round's trees; slots are classes."""
    rows = trees.rows_of(_rows(spark, sf_dir))
    edges = trees.thresholds(trees.bins(rows), D)
    base = trees.start(rows, 3)
    width = max(map(len, edges)) + 2
    return trees.histograms(trees.encoded(rows, D, edges, base), D, [], [trees.stump(0.0)] * 3, [{0: k} for k in range(3)], width), width


def first_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and derivatives by class, feature and bin before the first tree; bin 0 is missing."""
    sums, _ = _first_sums(spark, sf_dir)
    return rounded(sums.groupBy(F.col("slot").alias("klass"), "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")]))


def first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of each class's first tree."""
    sums, width = _first_sums(spark, sf_dir)
    best = trees.best_splits(trees.candidate_splits(sums, width, STRENGTH, LEAST))
    return rounded(best.select(F.col("slot").alias("klass"), "feature", "bin", "gain", "missing_left", F.col("all_n").alias("n"), F.col("left_n").alias("left_n"), "left_g", "left_h"))


def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all by ten rounds of boosting on four in five subjects, missing values kept."""
    data = _rows(spark, sf_dir)
    model = trees.boost(data.filter("subject % 5 <> 0"), D, 10, strength=STRENGTH, least=LEAST)
    return rounded(trees.scored(data, model.proba))


def boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean size of each feature's exact Shapley values, by class."""
    data = _rows(spark, sf_dir)
    model = trees.boost(data, D, 5, strength=STRENGTH, least=LEAST)
    parts = trees.contributions(data, model).select("klass", F.posexplode("phi").alias("feature", "phi"))
    return rounded(parts.groupBy("klass", "feature").agg(F.avg(F.abs("phi")).alias("importance"), F.count(F.lit(1)).alias("n")))


def contribution_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether contributions add up: the largest gap to the score, of all rows of a class."""
    data = _rows(spark, sf_dir)
    model = trees.boost(data, D, 3, strength=STRENGTH, least=LEAST)
    total = F.aggregate("phi", F.lit(0.0), lambda t, v: t + v) + F.col("base")
    return rounded(trees.contributions(data, model).groupBy("klass").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(total - F.col("raw"))).alias("gap")), 5)


def extra_trees_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject's scores by extremely randomised trees of the other folds, values filled and scaled."""
    from pyspark.ml.functions import vector_to_array

    data = _vectors(spark, sf_dir).select("subject", "y", vector_to_array("features").alias("x"))
    fit = lambda train: trees.extra_trees(train, D, 10, depth=6, seed=SEED)
    return rounded(learners.out_of_fold(fit, data, folds.stratified_folds(data, 3, SEED), 3))


def neighbour_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature tells of the class, by three nearest neighbours."""
    m = b.matrix(spark, sf_dir)
    return rounded(matrix.neighbour_information(matrix.fill(m, matrix.fit_statistics(m))))


QUERIES = {f.__name__: f for f in (feature_bins, first_histogram, first_splits, boosted_scores, boosted_importance, contribution_sums, extra_trees_out_of_fold, neighbour_information)}

_BINS = f"""
{_MATRIX},
cell AS (SELECT feature, value, count(*) AS n FROM m WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value) AS upto, sum(n) OVER (PARTITION BY feature) AS total, count(*) OVER (PARTITION BY feature) AS kinds,
  row_number() OVER (PARTITION BY feature ORDER BY value) AS place FROM cell),
placed AS (SELECT feature, value, n, CASE WHEN kinds <= 63 THEN place - 1 ELSE CAST(upto - n AS BIGINT) * 63 // CAST(total AS BIGINT) END AS turn FROM ranked),
held AS (SELECT feature, turn, min(value) AS low, max(value) AS high, CAST(sum(n) AS BIGINT) AS n FROM placed GROUP BY feature, turn),
bins AS (SELECT feature, CAST(row_number() OVER w AS INTEGER) AS bin, low, high, n, (high + lead(low) OVER w) / 2 AS threshold FROM held WINDOW w AS (PARTITION BY feature ORDER BY turn))"""
_HISTOGRAM = f"""
{_BINS},
s AS (SELECT y AS klass, count(DISTINCT subject) / (SELECT count(DISTINCT subject) FROM m)::DOUBLE AS p FROM m GROUP BY y),
b AS (SELECT m.subject, m.y, m.feature, coalesce(bins.bin, 0) AS bin FROM m LEFT JOIN bins ON m.feature = bins.feature AND m.value BETWEEN bins.low AND bins.high),
hist AS (SELECT klass, feature, bin, count(*) AS n, sum(p - CAST(y = klass AS INTEGER)) AS g, sum(p * (1 - p)) AS h FROM b, s GROUP BY ALL)"""
_GAIN = lambda g, h: f"{g} * {g} / ({h} + {STRENGTH})"
ORACLE_SQL: dict[str, str] = {
    "feature_bins": f"WITH {_BINS} SELECT feature, bin, {_r('low', 'low')}, {_r('high', 'high')}, n, {_r('threshold', 'threshold')} FROM bins",
    "first_histogram": f"WITH {_HISTOGRAM} SELECT klass, feature, bin, n, {_r('g', 'g')}, {_r('h', 'h')} FROM hist",
    "first_splits": f"""
WITH {_HISTOGRAM},
w AS (SELECT *, sum(n) OVER a AS all_n, sum(g) OVER a AS all_g, sum(h) OVER a AS all_h, sum(n) OVER u AS upto_n, sum(g) OVER u AS upto_g, sum(h) OVER u AS upto_h,
  coalesce(sum(n) FILTER (bin = 0) OVER a, 0) AS none_n, coalesce(sum(g) FILTER (bin = 0) OVER a, 0) AS none_g, coalesce(sum(h) FILTER (bin = 0) OVER a, 0) AS none_h
  FROM hist WINDOW a AS (PARTITION BY klass, feature), u AS (PARTITION BY klass, feature ORDER BY bin)),
d AS (SELECT *, upto_n - none_n * (1 - l) AS left_n, upto_g - none_g * (1 - l) AS left_g, upto_h - none_h * (1 - l) AS left_h, l = 1 AS missing_left FROM w, (VALUES (0), (1)) AS t(l) WHERE bin > 0),
o AS (SELECT *, {_GAIN("left_g", "left_h")} + {_GAIN("(all_g - left_g)", "(all_h - left_h)")} - {_GAIN("all_g", "all_h")} AS gain FROM d
  WHERE left_n >= {LEAST} AND all_n - left_n >= {LEAST} AND (none_n > 0 OR missing_left = (left_n >= all_n - left_n)))
SELECT klass, feature, bin, {_r("gain", "gain")}, missing_left, CAST(all_n AS BIGINT) AS n, CAST(left_n AS BIGINT) AS left_n, {_r("left_g", "left_g")}, {_r("left_h", "left_h")} FROM o
QUALIFY row_number() OVER (PARTITION BY klass ORDER BY round(gain, 9) DESC, feature, bin, missing_left DESC) = 1""",
    # additivity is a law: no gap, for every row and class
    "contribution_sums": "SELECT klass, count(*) AS n, 0.0::DOUBLE AS gap FROM embeddings, (VALUES (0), (1), (2)) AS t(klass) GROUP BY klass",
    "neighbour_information": f"""
WITH {_MATRIX},
c AS (SELECT feature, y, count(*) AS size FROM filled GROUP BY ALL HAVING count(*) > 1),
f AS (SELECT subject, f.y, f.feature, f.value, size, least(3, size - 1) AS k FROM filled f JOIN c ON f.feature = c.feature AND f.y = c.y),
near AS (
  SELECT p.subject, p.feature, any_value(p.k) AS k, list_sort(list(abs(p.value - q.value)))[any_value(p.k)] AS r
  FROM f p JOIN f q ON p.feature = q.feature AND p.y = q.y AND p.subject <> q.subject GROUP BY p.subject, p.feature),
inside AS (
  SELECT p.subject, p.feature, any_value(p.size) AS size, any_value(p.k) AS k, count(*) AS m
  FROM f p JOIN near USING (subject, feature) JOIN f q ON p.feature = q.feature AND (abs(p.value - q.value) < r OR p.value = q.value) GROUP BY p.subject, p.feature),
-- the digamma function of whole numbers: harmonic sums less Euler's constant
psi AS (SELECT i, -0.57721566490153286 + coalesce(sum(1.0::DOUBLE / (i - 1)) FILTER (i > 1) OVER (ORDER BY i), 0) AS psi FROM range(1, (SELECT count(*) + 2 FROM embeddings)) t(i))
SELECT feature, {_r("greatest(0, (SELECT psi FROM psi WHERE i = any_value(total)) + avg(pk.psi) - avg(ps.psi) - avg(pm.psi))", "mi")}
FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS total FROM inside) x JOIN psi pk ON pk.i = x.k JOIN psi ps ON ps.i = x.size JOIN psi pm ON pm.i = x.m
GROUP BY feature""",
}
