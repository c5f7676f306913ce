"""Queries of searches, explanations and looks at the data, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, learners, matrix, policy
from ..operators.lineage import checkpointed
from . import bindings as b
from .learner_queries import _vectors
from .model_queries import _FIG, _MATRIX, _SCORES, SEED, _counts, _hash48, _scores
from .model_queries import ORACLE_SQL as _MODEL_SQL
from .signal_queries import _r, rounded

VOTES = 1200
RECIPES = 2500


def keep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best features, in the order of the columns."""
    return rounded(matrix.keep_order(b.matrix(spark, sf_dir), 20))


def missing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.missing_shares(b.matrix(spark, sf_dir)))


def class_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.class_boxes(b.matrix(spark, sf_dir)))


def vote_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 1,200 votes among the scores, two flattened and one sharpened form of them."""
    p = [F.col(f"p{k}") for k in range(3)]
    shifts = (0.0, 0.0, 0.0)
    members = [p, policy.flat_scores(p, 2.0, shifts), policy.flat_scores(p, 0.5, shifts), policy.flat_scores(p, 1.0, (0.0, 0.5, 0.0)), policy.flat_scores(p, 1.0, (0.0, 0.0, 0.5))]
    return rounded(policy.vote_search(_scores(spark, sf_dir), members, VOTES, SEED))


def recipe_search_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of 2,500 random recipes."""
    return rounded(policy.recipe_search(_scores(spark, sf_dir), RECIPES, SEED))


def shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to each subject's log scores by linear discriminants."""
    data = _vectors(spark, sf_dir)
    w, c = learners.discriminant_weights(data)

    def log_shares(z, axis):
        z = z - z.max(axis, keepdims=True)
        return z - np.log(np.exp(z).sum(axis, keepdims=True))

    return rounded(learners.shapley_values(data, learners.LinearScore(w, c, log_shares), learners.background_rows(data, SEED), SEED))


def parameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trials of each of two families on three folds."""
    data = checkpointed(_vectors(spark, sf_dir))
    return rounded(learners.parameter_search(data, folds.stratified_folds(data, 3, SEED), 3, ["logistic", "forest"], 2, SEED))


QUERIES = {f.__name__: f for f in (keep_order, missing_shares, class_boxes, vote_search, recipe_search_whole, shapley_values, parameter_search)}

_N = 5
_UNIT = lambda *what: f"(({_hash48(f"'{SEED}:' || i || '" + ''.join(f':{x}' for x in what) + "'")} + 1) / 281474976710656.0::DOUBLE)"
_FORMS = [("1.0", (0, 0, 0)), ("2.0", (0, 0, 0)), ("0.5", (0, 0, 0)), ("1.0", (0, 0.5, 0)), ("1.0", (0, 0, 0.5))]
ORACLE_SQL: dict[str, str] = {
    "missing_shares": f"""
WITH {_MATRIX} SELECT feature, {_r("1 - count(value) / count(*)::DOUBLE", "missing_fraction")}, count(value) AS present FROM m
GROUP BY feature ORDER BY 1 - count(value) / count(*)::DOUBLE DESC, feature LIMIT 15""",
    "class_boxes": f"""
WITH {_MATRIX}, v AS (SELECT * FROM m WHERE value IS NOT NULL),
q AS (SELECT feature, y, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY ALL),
z AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v JOIN q USING (feature, y))
SELECT feature, y, {_r("q1", "q1")}, {_r("median", "median")}, {_r("q3", "q3")}, count(*) AS n, {_r("min(value) FILTER (WHERE inside)", "low")}, {_r("max(value) FILTER (WHERE inside)", "high")},
  count(*) FILTER (WHERE NOT inside) AS n_outside FROM z GROUP BY feature, y, q1, median, q3""",
    "keep_order": f"""
WITH {_MATRIX}, u AS (SELECT feature FROM m GROUP BY feature HAVING count(value) >= greatest(2, ceil((SELECT count(DISTINCT subject) FROM m) * 0.1)) AND count(DISTINCT value) > 1),
c AS (SELECT feature, y, count(*) AS n, avg(value) AS a, var_pop(value) AS v FROM filled WHERE feature IN (SELECT feature FROM u) GROUP BY ALL),
g AS (SELECT *, sum(n * a) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS grand FROM c),
f AS (SELECT feature, (sum(n * (a - grand) * (a - grand)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM g GROUP BY feature),
k AS (SELECT *, row_number() OVER (ORDER BY f DESC, feature) AS rank FROM f)
SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS place, feature, CAST(rank AS INTEGER) AS rank, {_r("f", "f")} FROM k WHERE rank <= 20""",
    "vote_search": f"""
WITH {_SCORES}, e AS (SELECT y, {", ".join(f"exp(ln(p{k}) / {t} + {s[k]}) AS e{m}_{k}" for m, (t, s) in enumerate(_FORMS) for k in range(3))} FROM said),
x AS (SELECT y, {", ".join(f"e{m}_{k} / (e{m}_0 + e{m}_1 + e{m}_2) AS s{m}_{k}" for m in range(_N) for k in range(3))} FROM e),
u AS (SELECT CAST(i AS INTEGER) AS i, 2 + floor({_UNIT(0)} * 4) AS size, {", ".join(f"{_UNIT(1, m)} AS o{m}" for m in range(_N))},
  {", ".join(f"-ln(CASE WHEN i % 2 = 1 THEN {_UNIT(2, m, k)} ELSE {_UNIT(2, m, 0)} END) AS d{m}_{k}" for m in range(_N) for k in range(3))} FROM range({VOTES}) r(i)),
h AS (SELECT i, {", ".join(f"CASE WHEN {' + '.join(f'CAST(o{n} < o{m} AS INTEGER)' for n in range(_N) if n != m)} < size THEN d{m}_{k} ELSE 0 END AS w{m}_{k}" for m in range(_N) for k in range(3))} FROM u),
s AS (SELECT i, i % 2 = 1 AS by_class, y, {", ".join("(" + " + ".join(f"s{m}_{k} * w{m}_{k}" for m in range(_N)) + ") / (" + " + ".join(f"w{m}_{k}" for m in range(_N)) + f") AS z{k}" for k in range(3))} FROM x, h),
n AS (SELECT i, by_class, y, z0 / (z0 + z1 + z2) AS p0, z1 / (z0 + z1 + z2) AS p1, z2 / (z0 + z1 + z2) AS p2 FROM s),
t AS (SELECT *, CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1 ELSE 2 END AS predicted FROM n),
c AS ({_counts("t", "i, by_class")}),
ovr AS ({" UNION ALL ".join(f"SELECT i, {k} AS class, round(p{k}, 9) AS score, CAST(y = {k} AS BIGINT) AS hit FROM n" for k in range(3))}),
steps AS (SELECT i, class, score, sum(hit) AS hits, sum(1 - hit) AS misses FROM ovr GROUP BY ALL),
run AS (SELECT *, sum(misses) OVER (PARTITION BY i, class ORDER BY score DESC) AS fp, sum(hits) OVER (PARTITION BY i, class) AS pos, sum(misses) OVER (PARTITION BY i, class) AS neg FROM steps),
a AS (SELECT i, avg(auc) AS auc FROM (SELECT i, class, sum(hits * (neg - fp + misses / 2.0)) / (max(pos) * max(neg))::DOUBLE AS auc FROM run GROUP BY ALL) GROUP BY i),
r AS (SELECT i, by_class, auc, {_FIG["macro_recall"]} AS macro_recall, {_FIG["macro_f1"]} AS macro_f1 FROM c JOIN a USING (i)),
o AS (SELECT *, CASE WHEN auc >= 0.8 AND macro_recall >= 0.8 THEN 1 ELSE 0 END + least(auc, macro_recall) + 0.02 * (auc + macro_recall) / 2 + 0.001 * macro_f1 AS objective FROM r)
SELECT i, by_class, {', '.join(_r(z, z) for z in ('auc', 'macro_recall', 'macro_f1', 'objective'))} FROM o ORDER BY round(objective, 9) DESC, i LIMIT 20""",
}
ORACLE_SQL["recipe_search_whole"] = _MODEL_SQL["recipe_search"].replace("range(200)", f"range({RECIPES})")
