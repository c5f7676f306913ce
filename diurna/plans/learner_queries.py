"""Queries of models, resampling and explanations: no SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, folds, learners, matrix
from ..operators.lineage import checkpointed
from . import bindings as b
from .model_queries import _MATRIX, _STATS, SEED
from .signal_queries import _r, rounded

FEATURES = list(range(64))  # all of an embedding


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.matrix(spark, sf_dir).filter(F.col("feature").isin(FEATURES))
    return matrix.scale(m, matrix.fit_statistics(m))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.vectors(_scaled(spark, sf_dir), FEATURES)


def logistic_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _vectors(spark, sf_dir)
    return rounded(learners.out_of_fold(learners.logistic(0.1), data, folds.stratified_folds(data, 3, SEED), 3))


def forest_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _vectors(spark, sf_dir)
    return rounded(learners.out_of_fold(learners.forest(10, 4), data, folds.stratified_folds(data, 3, SEED), 3))


def discriminant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _vectors(spark, sf_dir)
    return rounded(learners.discriminant(data.filter("subject % 5 <> 0"))(data))


def kernel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject's scores by a machine of the other four folds."""
    data = checkpointed(_vectors(spark, sf_dir))
    parts = [learners.kernel_machine(data.filter(f"pmod(subject, 5) <> {f}"))(data.filter(f"pmod(subject, 5) = {f}")) for f in range(5)]
    return rounded(reduce(DataFrame.unionByName, parts))


def kernel_ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all by kernel ridge, learned from four in five subjects."""
    data = _vectors(spark, sf_dir)
    return rounded(learners.kernel_ridge(data.filter("subject % 5 <> 0"))(data))


def class_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learners.neighbours(checkpointed(_vectors(spark, sf_dir))))


def oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learners.oversample(_vectors(spark, sf_dir), SEED)
    return out.withColumn("features", F.transform("features", lambda x: F.round(x, 6)))


def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = learners.principal_components(_vectors(spark, sf_dir), 3)
    return out.select("subject", "y", F.transform(vector_to_array("features"), lambda x: F.round(F.abs(x), 6)).alias("components"))


def permuted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC lost by each feature in each of 50 permutations."""
    long = checkpointed(_scaled(spark, sf_dir))
    score = learners.discriminant(checkpointed(learners.vectors(long, FEATURES)))
    return rounded(learners.permutation_importance(score, long, FEATURES, 50, SEED))


def permuted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC lost by four groups of features in 50 permutations each, summed up."""
    long = checkpointed(_scaled(spark, sf_dir))
    score = learners.discriminant(checkpointed(learners.vectors(long, FEATURES)))
    groups = {f"group_{g}": FEATURES[16 * g : 16 * g + 16] for g in range(4)}
    drops = learners.permutation_importance(score, long, FEATURES, 50, SEED, groups)
    return rounded(features.drop_summary(drops, ["feature"]))


def embedding_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of features; ``feature_correlations`` has the first twelve."""
    m = b.matrix(spark, sf_dir)
    return rounded(learners.vector_correlations(learners.vectors(matrix.fill(m, matrix.fit_statistics(m)), FEATURES), FEATURES))


QUERIES = {
    f.__name__: f
    for f in (logistic_out_of_fold, forest_out_of_fold, discriminant_scores, kernel_scores, kernel_ridge_scores, class_neighbours, oversampled, principal_components, permuted_importance, permuted_groups, embedding_correlations)
}
_SCALED = f"""
{_MATRIX}, s AS ({_STATS} FROM filled GROUP BY feature),
x AS (SELECT subject, y, feature, greatest(-20, least(20, (coalesce(value, s.fill) - center) / scale)) AS value FROM m JOIN s USING (feature))"""
ORACLE_SQL: dict[str, str] = {
    "embedding_correlations": f"""
WITH {_MATRIX} SELECT x.feature AS a, z.feature AS b, {_r("corr(x.value, z.value)", "r")} FROM filled x JOIN filled z ON x.subject = z.subject AND x.feature < z.feature GROUP BY ALL""",
    "class_neighbours": f"""
WITH {_SCALED}, d AS (
  SELECT p.subject, p.y, q.subject AS neighbour, sqrt(sum((p.value - q.value) * (p.value - q.value))) AS distance
  FROM x p JOIN x q ON p.y = q.y AND p.feature = q.feature AND p.subject <> q.subject GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY distance, neighbour) - 1 AS rank FROM d)
SELECT subject, y, CAST(rank AS INTEGER) AS rank, neighbour, {_r("distance", "distance")} FROM k WHERE rank < 5""",
}
