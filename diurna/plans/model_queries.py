"""Queries of the metric, policy, matrix and fold operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import argmax
from ..operators import folds, matrix, metrics, policy, ranking
from . import bindings as b
from .signal_queries import _r, rounded

SEED = 2026


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.scores(spark, sf_dir)
    return s.withColumn("predicted", argmax([F.col("p0"), F.col("p1"), F.col("p2")]))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy."""
    return rounded(metrics.report(metrics.confusion(_scores(spark, sf_dir))))


def score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, average precision and best balanced recall by class."""
    return rounded(metrics.areas(metrics.curve(metrics.one_vs_rest(_scores(spark, sf_dir)))).drop("misses_above_last"))


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC and precision-recall points; scores rounded first."""
    rows = metrics.one_vs_rest(_scores(spark, sf_dir)).withColumn("score", F.round(F.col("score") + 3e-10, 4))
    return rounded(metrics.curve(rows).select("class", "score", "tp", "fp", "tpr", "fpr", "precision"))


def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir).agg(metrics.log_loss(_scores(spark, sf_dir)).alias("log_loss"), F.count(F.lit(1)).alias("n")))


def label_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well text length tells the two quality labels apart."""
    d, l = b.table(spark, sf_dir, "documents"), b.table(spark, sf_dir, "labels")  # noqa: E741
    rows = d.join(l, "doc_id").select(F.lit(0).alias("class"), F.col("n_chars").cast("double").alias("score"), F.col("quality").cast("long").alias("hit"))
    return rounded(metrics.areas(metrics.curve(rows)).drop("misses_above_last"))


GRID = [-1.5 + 0.25 * i for i in range(13)]


def offset_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 169 pairs of class offsets."""
    best = policy.best_offset(policy.evaluate_offsets(_scores(spark, sf_dir), policy.grid(GRID)))
    return rounded(best.select("i", "a", "b", "macro_recall", "macro_f1", "accuracy", "norm"))


def offset_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of all 169 pairs of class offsets."""
    return rounded(policy.evaluate_offsets(_scores(spark, sf_dir), policy.grid(GRID)))


def two_step_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, fine = [-4 + i / 3 for i in range(25)], [-0.35 + 0.05 * i for i in range(15)]
    return rounded(policy.two_step_policy(_scores(spark, sf_dir), wide, fine))


def recipe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ensemble of a flat and a nested recipe."""
    p = [F.col(f"p{k}") for k in range(3)]
    flat = policy.flat_scores(p, 1.5, [0.0, 0.1, -0.2])
    nested = policy.nested_scores(policy.tempered(p[2], 0.8), policy.tempered(p[1], bias=0.3))
    mixed = policy.voted_scores([flat, nested], [[2.0, 1.0, 1.0], 1.0])
    return rounded(_scores(spark, sf_dir).select("id", *[c.alias(f"q{k}") for k, c in enumerate(mixed)]))


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of 125 subjects, pooled over their rows, to four digits; class subject % 3."""
    pooled = policy.pool(_scores(spark, sf_dir).withColumn("key", F.col("id") % 125), "key")
    return pooled.select((F.col("key") % 3).cast("int").alias("y"), *[F.round(F.col(f"p{k}") + 3e-10, 4).alias(f"p{k}") for k in range(3)])


def breakpoint_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all offsets that decide differently."""
    return rounded(policy.breakpoint_policy(_pooled(spark, sf_dir), (0.25, -0.25)))


def breakpoint_policy_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best offsets over all subjects of four rows each, as many as the table gives."""
    pooled = policy.pool(_scores(spark, sf_dir).withColumn("key", F.expr("id div 4")), "key")
    subjects = pooled.select((F.col("key") % 3).cast("int").alias("y"), *[F.round(F.col(f"p{k}") + 3e-10, 4).alias(f"p{k}") for k in range(3)])
    return rounded(policy.breakpoint_policy(subjects, (0.25, -0.25)))


def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middles between the distinct rounded scores of the first class."""
    return rounded(ranking.midpoints(_scores(spark, sf_dir).select(F.round(F.col("p0") + 3e-10, 3).alias("middle")), "middle"))


def recipe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of 200 random recipes."""
    return rounded(policy.recipe_search(_scores(spark, sf_dir), 200, SEED))


def blend_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five weights of two raw score tables, with three shifts of two classes each."""
    e = b.table(spark, sf_dir, "embeddings")
    raw = e.select(b.class_of("label").alias("y"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("a0", "a1", "a2", "b0", "b1", "b2"))])
    return rounded(policy.blend_grid(raw, ["a0", "a1", "a2"], ["b0", "b1", "b2"], [0.0, 0.25, 0.5, 0.75, 1.0], [-0.2, 0.0, 0.2]))


def pooled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores pooled over groups of four, by both means."""
    s = _scores(spark, sf_dir).withColumn("key", F.col("id") % 125)
    a, g = policy.pool(s, "key"), policy.pool(s, "key", geometric=True)
    return rounded(a.join(g.select("key", *[F.col(f"p{k}").alias(f"g{k}") for k in range(3)]), "key"))


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both objectives and the target flag, by label as model."""
    s = _scores(spark, sf_dir).withColumn("model", F.col("id") % 5)
    r = metrics.report(metrics.confusion(s, by=["model"]))
    auc = F.col("accuracy")
    return rounded(
        r.select(
            "model",
            policy.objective(auc, F.col("macro_recall"), F.col("macro_f1")).alias("objective"),
            policy.objective_with_target(auc, F.col("macro_recall"), F.col("macro_f1"), 0.3).alias("targeted"),
            ((auc >= 0.3) & (F.col("macro_recall") >= 0.3)).alias("target_met"),
        )
    )


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of accuracy and macro recall over 100 resamples."""
    return _intervals(spark, sf_dir, 100)


def bootstrap_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over 2,000 resamples."""
    return _intervals(spark, sf_dir, 2000)


def _intervals(spark: SparkSession, sf_dir: str, repeats: int) -> DataFrame:
    draws = folds.bootstrap(_scores(spark, sf_dir).select("id", "y", "predicted"), repeats, SEED)
    r = metrics.report(metrics.confusion(draws, by=["repeat"]))
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    one = r.agg(q("accuracy").alias("a"), q("macro_recall").alias("m"), F.count(F.lit(1)).alias("repeats"))
    return rounded(one.select("repeats", *[F.col(c)[i].alias(f"{n}_{e}") for c, n in (("a", "accuracy"), ("m", "macro_recall")) for i, e in ((0, "low"), (1, "high"))]))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.scores(spark, sf_dir).select(F.col("id").alias("subject"), "y")


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(_subjects(spark, sf_dir), 5, SEED)


def nested_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.nested_folds(_subjects(spark, sf_dir), 5, 3, SEED)


def fold_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.composition(folds.group_folds(_subjects(spark, sf_dir), 5, SEED), 5)


def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable features, fill, centre and scale."""
    m = b.matrix(spark, sf_dir)
    return rounded(matrix.usable_features(m).join(matrix.fit_statistics(m), "feature"))


def anova_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.matrix(spark, sf_dir)
    return rounded(matrix.anova(matrix.fill(m, matrix.fit_statistics(m))).select("feature", "f", "rank"), 4)


def scaled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values scaled by statistics of four in five subjects."""
    m = b.matrix(spark, sf_dir)
    s = matrix.fit_statistics(m.filter("subject % 5 <> 0"))
    r = matrix.scale(m, s).withColumnRenamed("value", "robust")
    z = matrix.scale(m, s, "standard", 30.0).withColumnRenamed("value", "standard")
    return rounded(r.join(z, ["subject", "y", "feature"]))


def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.matrix(spark, sf_dir)
    return rounded(matrix.correlations(matrix.fill(m, matrix.fit_statistics(m)), list(range(12))))


def class_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.matrix(spark, sf_dir)
    return rounded(matrix.mutual_information(matrix.fill(m, matrix.fit_statistics(m))))


def matrix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.audit(b.matrix(spark, sf_dir)))


def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 90).alias("subject"), ((F.col("vec_id") % 90) % 3).cast("int").alias("y"))
    return rounded(matrix.subject_weights(rows, 0.5).groupBy("subject", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight")))


def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.matrix(spark, sf_dir)
    return rounded(matrix.gaussian_scores(matrix.fill(m, matrix.fit_statistics(m))))


QUERIES = {
    f.__name__: f
    for f in (
        classification_report, score_quality, curve_points, log_loss, label_auc, offset_policy, offset_grid, two_step_policy, recipe_scores,
        pooled_scores, objectives, bootstrap_interval, stratified_folds, nested_folds, fold_composition, feature_statistics, anova_ranking,
        scaled_matrix, feature_correlations, class_information, matrix_audit, sample_weights, naive_bayes, breakpoint_policy, breakpoint_policy_whole, breakpoints, blend_grid,
        recipe_search,
        bootstrap_percentiles,
    )
}

_Y = "CASE WHEN label <= 5 THEN 0 WHEN label <= 8 THEN 1 ELSE 2 END"
_SCORES = f"""
raw AS (SELECT vec_id AS id, {_Y} AS y, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
ex AS (SELECT id, y, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b, exp(c - greatest(a, b, c)) AS c FROM raw),
scores AS (SELECT id, y, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM ex),
said AS (SELECT *, CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1 ELSE 2 END AS predicted FROM scores)"""


def _counts(source: str, by: str = "") -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE y = {i} AND predicted = {j}) AS n{i}{j}" for i in range(3) for j in range(3))
    return f"SELECT {by + ', ' if by else ''}{cells} FROM {source}" + (f" GROUP BY {by}" if by else "")


def _figures() -> dict[str, str]:
    out = {}
    for k in range(3):
        hit, actual, told = f"n{k}{k}", f"(n{k}0 + n{k}1 + n{k}2)", f"(n0{k} + n1{k} + n2{k})"
        out[f"precision_{k}"] = f"coalesce({hit} / nullif({told}, 0)::DOUBLE, 0)"
        out[f"recall_{k}"] = f"coalesce({hit} / nullif({actual}, 0)::DOUBLE, 0)"
        out[f"f1_{k}"] = f"coalesce(2 * {hit} / nullif({actual} + {told}, 0)::DOUBLE, 0)"
    for name in ("precision", "recall", "f1"):
        out[f"macro_{name}"] = "(" + " + ".join(out[f"{name}_{k}"] for k in range(3)) + ") / 3"
    out["accuracy"] = "(n00 + n11 + n22) / nullif(n00 + n01 + n02 + n10 + n11 + n12 + n20 + n21 + n22, 0)::DOUBLE"
    return out


_FIG = _figures()
_OVR = """
ovr AS (
  SELECT 0 AS class, p0 AS score, CAST(y = 0 AS BIGINT) AS hit FROM said UNION ALL SELECT 1, p1, CAST(y = 1 AS BIGINT) FROM said UNION ALL
  SELECT 2, p2, CAST(y = 2 AS BIGINT) FROM said)"""
_AREAS = f"""
steps AS (SELECT class, score, sum(hit) AS hits, sum(1 - hit) AS misses FROM ovr GROUP BY ALL),
run AS (
  SELECT *, sum(hits) OVER o AS tp, sum(misses) OVER o AS fp, sum(hits) OVER (PARTITION BY class) AS pos, sum(misses) OVER (PARTITION BY class) AS neg
  FROM steps WINDOW o AS (PARTITION BY class ORDER BY score DESC))
SELECT class, {_r("sum(hits * (neg - fp + misses / 2.0)) / (max(pos) * max(neg))::DOUBLE", "auc")},
  {_r("sum(hits / pos::DOUBLE * (tp / (tp + fp)::DOUBLE))", "average_precision")},
  {_r("greatest(0.5, max((tp / pos::DOUBLE + 1 - fp / neg::DOUBLE) / 2))", "best_balanced_recall")}
FROM run GROUP BY class"""
_GRID_SQL = f"""
g AS (SELECT CAST(13 * i + j AS INTEGER) AS i, -1.5 + 0.25 * i AS a, -1.5 + 0.25 * j AS b FROM range(13) x(i), range(13) z(j)),
gd AS (SELECT i, a::DOUBLE AS a, b::DOUBLE AS b FROM g),
logs AS (SELECT y, ln(least(greatest(p0, 1e-12), 1)) AS l0, ln(least(greatest(p1, 1e-12), 1)) AS l1, ln(least(greatest(p2, 1e-12), 1)) AS l2 FROM said),
shifted AS (SELECT i, a, b, y, l0, l1 + a AS l1, l2 + b AS l2 FROM logs, gd),
pred AS (SELECT i, a, b, y, CASE WHEN l0 = greatest(l0, l1, l2) THEN 0 WHEN l1 = greatest(l0, l1, l2) THEN 1 ELSE 2 END AS predicted FROM shifted),
counts AS ({_counts("pred", "i, a, b")}),
fig AS (
  SELECT i, a, b, {_FIG["macro_recall"]} AS macro_recall, least({_FIG["recall_0"]}, {_FIG["recall_1"]}, {_FIG["recall_2"]}) AS min_recall,
    {_FIG["macro_f1"]} AS macro_f1, {_FIG["accuracy"]} AS accuracy,
    sqrt(power((a + b) / 3, 2) + power(a - (a + b) / 3, 2) + power(b - (a + b) / 3, 2)) AS norm FROM counts)"""
_MATRIX = f"""
m AS (
  SELECT subject, y, feature, CASE WHEN (subject + feature) % 17 <> 0 THEN v END AS value FROM (
    SELECT vec_id AS subject, {_Y} AS y, unnest(range(len(embedding)))::INTEGER AS feature, unnest(embedding)::DOUBLE AS v FROM embeddings)),
med AS (SELECT feature, coalesce(median(value), 0) AS fill FROM m GROUP BY feature),
filled AS (SELECT m.subject, m.y, m.feature, coalesce(m.value, fill) AS value, fill FROM m JOIN med USING (feature))"""
_STATS = """
SELECT feature, any_value(fill) AS fill, quantile_cont(value, 0.5) AS center,
  CASE WHEN quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS scale,
  avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS std"""
_FOLDS = f"SELECT subject, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || subject)) - 1) % 5 AS INTEGER) AS fold FROM subjects"
_SUBJECTS = f"subjects AS (SELECT DISTINCT vec_id AS subject, {_Y} AS y FROM embeddings)"


def _hash48(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


ORACLE_SQL = {
    "classification_report": f"""
WITH {_SCORES}, c AS ({_counts("said")})
SELECT n00, n01, n02, n10, n11, n12, n20, n21, n22, n00 + n01 + n02 AS support_0, n10 + n11 + n12 AS support_1, n20 + n21 + n22 AS support_2,
  {", ".join(_r(e, n) for n, e in _FIG.items())} FROM c""",
    "score_quality": f"WITH {_SCORES}, {_OVR}, {_AREAS}",
    "curve_points": f"""
WITH {_SCORES}, {_OVR}, steps AS (SELECT class, round(score + 3e-10, 4) AS score, sum(hit) AS hits, sum(1 - hit) AS misses FROM ovr GROUP BY ALL),
run AS (
  SELECT *, sum(hits) OVER o AS tp, sum(misses) OVER o AS fp, sum(hits) OVER (PARTITION BY class) AS pos, sum(misses) OVER (PARTITION BY class) AS neg
  FROM steps WINDOW o AS (PARTITION BY class ORDER BY score DESC))
SELECT class, {_r("score", "score")}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {_r("tp / pos::DOUBLE", "tpr")}, {_r("fp / neg::DOUBLE", "fpr")}, {_r("tp / (tp + fp)::DOUBLE", "precision")} FROM run""",
    "log_loss": f"""
WITH {_SCORES} SELECT {_r("-avg(ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END / (p0 + p1 + p2)))", "log_loss")}, count(*) AS n FROM said""",
    "label_auc": f"WITH ovr AS (SELECT 0 AS class, CAST(n_chars AS DOUBLE) AS score, CAST(quality AS BIGINT) AS hit FROM documents JOIN labels USING (doc_id)), {_AREAS}",
    "offset_grid": f"WITH {_SCORES}, {_GRID_SQL} SELECT i, {', '.join(_r(c, c) for c in ('a', 'b', 'macro_recall', 'min_recall', 'macro_f1', 'accuracy', 'norm'))} FROM fig",
    "offset_policy": f"""
WITH {_SCORES}, {_GRID_SQL}
SELECT i, {', '.join(_r(c, c) for c in ('a', 'b', 'macro_recall', 'macro_f1', 'accuracy', 'norm'))} FROM fig
ORDER BY round(macro_recall, 12) DESC, round(macro_f1, 12) DESC, round(norm, 12), i DESC LIMIT 1""",
    "recipe_scores": f"""
WITH {_SCORES},
f AS (SELECT id, p1, p2, exp(ln(p0) / 1.5) AS a, exp(ln(p1) / 1.5 + 0.1) AS b, exp(ln(p2) / 1.5 - 0.2) AS c FROM said),
h AS (
  SELECT *, 1 / (1 + exp(-(ln(least(greatest(p2, 1e-9), 1 - 1e-9) / (1 - least(greatest(p2, 1e-9), 1 - 1e-9))) / 0.8))) AS d,
    1 / (1 + exp(-(ln(least(greatest(p1, 1e-9), 1 - 1e-9) / (1 - least(greatest(p1, 1e-9), 1 - 1e-9))) + 0.3))) AS q FROM f),
e AS (
  SELECT id, a / (a + b + c) * 2 / 3 + (1 - d) * (1 - q) / 3 AS x, b / (a + b + c) / 2 + (1 - d) * q / 2 AS y, c / (a + b + c) / 2 + d / 2 AS z FROM h)
SELECT id, {_r("x / (x + y + z)", "q0")}, {_r("y / (x + y + z)", "q1")}, {_r("z / (x + y + z)", "q2")} FROM e""",
    "pooled_scores": f"""
WITH {_SCORES}, a AS (
  SELECT id % 125 AS key, avg(p0) AS a, avg(p1) AS b, avg(p2) AS c, exp(avg(ln(p0))) AS d, exp(avg(ln(p1))) AS e, exp(avg(ln(p2))) AS f FROM said GROUP BY ALL)
SELECT key, {_r("a / (a + b + c)", "p0")}, {_r("b / (a + b + c)", "p1")}, {_r("c / (a + b + c)", "p2")},
  {_r("d / (d + e + f)", "g0")}, {_r("e / (d + e + f)", "g1")}, {_r("f / (d + e + f)", "g2")} FROM a""",
    "objectives": f"""
WITH {_SCORES}, s AS (SELECT *, id % 5 AS model FROM said), c AS ({_counts("s", "model")}),
r AS (SELECT model, {_FIG["accuracy"]} AS u, {_FIG["macro_recall"]} AS r, {_FIG["macro_f1"]} AS f FROM c)
SELECT model, {_r("least(u, r) + 1e-4 * (u + r) / 2 + 1e-6 * f", "objective")},
  {_r("CASE WHEN u >= 0.3 AND r >= 0.3 THEN 1 ELSE 0 END + least(u, r) + 0.02 * (u + r) / 2 + 0.001 * f", "targeted")}, u >= 0.3 AND r >= 0.3 AS target_met FROM r""",
    "bootstrap_interval": f"""
WITH {_SCORES}, k AS (SELECT y, predicted, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || id)) AS rank, count(*) OVER (PARTITION BY y) AS n FROM said),
draws AS (SELECT repeat, y, {_hash48(f"'{SEED}:' || repeat || ':' || y || ':' || rank")} % n + 1 AS rank FROM k, range(100) t(repeat)),
s AS (SELECT d.repeat, d.y, k.predicted FROM draws d JOIN k ON k.y = d.y AND k.rank = d.rank), c AS ({_counts("s", "repeat")}),
r AS (SELECT {_FIG["accuracy"]} AS a, {_FIG["macro_recall"]} AS m FROM c)
SELECT count(*) AS repeats, {_r("quantile_cont(a, 0.025)", "accuracy_low")}, {_r("quantile_cont(a, 0.975)", "accuracy_high")},
  {_r("quantile_cont(m, 0.025)", "macro_recall_low")}, {_r("quantile_cont(m, 0.975)", "macro_recall_high")} FROM r""",
    "stratified_folds": f"WITH {_SUBJECTS} {_FOLDS}",
    "nested_folds": f"""
WITH {_SUBJECTS}, f AS ({_FOLDS}), x AS (SELECT subject, y, fold, CAST(o AS INTEGER) AS outer_fold FROM f, range(5) t(o))
SELECT subject, y, outer_fold AS "outer", CAST((row_number() OVER (PARTITION BY outer_fold, y ORDER BY md5('{SEED + 1}:' || outer_fold || ':' || subject)) - 1) % 3 AS INTEGER) AS "inner"
FROM x WHERE fold <> outer_fold UNION ALL SELECT subject, y, outer_fold, NULL FROM x WHERE fold = outer_fold""",
    "fold_composition": f"""
WITH {_SUBJECTS}, g AS (SELECT subject, y, {_hash48(f"'{SEED}:' || subject")} % 5 AS own FROM subjects)
SELECT CAST(f AS INTEGER) AS fold, count(*) FILTER (WHERE own <> f) AS train_subjects, count(*) FILTER (WHERE own = f) AS test_subjects,
  {", ".join(f"count(*) FILTER (WHERE own {op} f AND y = {k}) AS {n}_{k}" for k in range(3) for n, op in (("train", "<>"), ("test", "=")))}
FROM g, range(5) t(f) GROUP BY f""",
    "feature_statistics": f"""
WITH {_MATRIX}, s AS ({_STATS} FROM filled GROUP BY feature),
u AS (SELECT feature, count(value) AS present, count(DISTINCT value) AS kinds FROM m GROUP BY feature)
SELECT feature, present, kinds, {', '.join(_r(c, c) for c in ('fill', 'center', 'scale', 'mean', 'std'))} FROM u JOIN s USING (feature)
WHERE present >= greatest(2, ceil((SELECT count(DISTINCT subject) FROM m) * 0.1)) AND kinds > 1""",
    "anova_ranking": f"""
WITH {_MATRIX}, c AS (SELECT feature, y, count(*) AS n, avg(value) AS a, var_pop(value) AS v FROM filled GROUP BY ALL),
g AS (SELECT feature, avg(value) AS g, count(*) AS n FROM filled GROUP BY feature),
f AS (SELECT feature, (sum(c.n * (a - g) * (a - g)) / (count(*) - 1)) / (sum(c.n * v) / (any_value(g.n) - count(*))) AS f FROM c JOIN g USING (feature) GROUP BY feature)
SELECT feature, round(f + 3e-10, 4) + 0.0 AS f, CAST(row_number() OVER (ORDER BY f DESC, feature) AS INTEGER) AS rank FROM f""",
    "scaled_matrix": f"""
WITH {_MATRIX}, tm AS (SELECT feature, coalesce(median(value), 0) AS fill FROM m WHERE subject % 5 <> 0 GROUP BY feature),
t AS (SELECT feature, coalesce(value, fill) AS value, fill FROM m JOIN tm USING (feature) WHERE subject % 5 <> 0), s AS ({_STATS} FROM t GROUP BY feature)
SELECT subject, y, feature, {_r("greatest(-20, least(20, (coalesce(value, fill) - center) / scale))", "robust")},
  {_r("greatest(-30, least(30, (coalesce(value, fill) - mean) / std))", "standard")} FROM m JOIN s USING (feature)""",
    "feature_correlations": f"""
WITH {_MATRIX} SELECT x.feature AS a, z.feature AS b, {_r("corr(x.value, z.value)", "r")}
FROM filled x JOIN filled z ON x.subject = z.subject AND x.feature < z.feature WHERE z.feature < 12 GROUP BY ALL""",
    "class_information": f"""
WITH {_MATRIX}, w AS (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM filled),
c AS (SELECT feature, y, coalesce(least(9, floor((value - lo) / nullif(hi - lo, 0) * 10)), 0) AS b, count(*) AS n FROM w GROUP BY ALL),
d AS (SELECT *, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS k FROM c)
SELECT feature, {_r("sum(n / k::DOUBLE * ln(n * k::DOUBLE / (nb * ny)::DOUBLE))", "mi")} FROM d GROUP BY feature""",
    "matrix_audit": f"""
WITH {_MATRIX}, k AS (SELECT count(*) AS constant_features FROM (SELECT feature FROM m GROUP BY feature HAVING count(DISTINCT value) <= 1)),
r AS (SELECT subject, list(value ORDER BY feature) AS row FROM m GROUP BY subject HAVING count(value) = count(*)),
t AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS repeated_rows FROM (SELECT row, count(*) AS n FROM r GROUP BY row))
SELECT count(DISTINCT subject) AS subjects, count(DISTINCT feature) AS features, {_r("1 - count(value) / count(*)::DOUBLE", "missing_fraction")},
  any_value(constant_features) AS constant_features, any_value(repeated_rows) AS repeated_rows FROM m, k, t""",
    "sample_weights": f"""
WITH r AS (SELECT vec_id % 90 AS subject, CAST((vec_id % 90) % 3 AS INTEGER) AS y FROM embeddings), o AS (SELECT subject, y, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT y, count(*) AS c FROM o GROUP BY y), w AS (SELECT subject, y, n, 1 / n::DOUBLE * power(c, -0.5) AS w FROM o JOIN c USING (y))
SELECT subject, y, n, {_r("w / (SELECT sum(w * n) / sum(n) FROM w)", "weight")} FROM w""",
    "naive_bayes": f"""
WITH {_MATRIX}, eps AS (SELECT max(v) * 1e-3 AS e FROM (SELECT var_pop(value) AS v FROM filled GROUP BY feature)),
s AS (SELECT y AS k, feature, avg(value) AS a, var_pop(value) + any_value(e) AS v FROM filled, eps GROUP BY ALL),
p AS (SELECT y AS k, ln(count(DISTINCT subject) / (SELECT count(DISTINCT subject) FROM filled)::DOUBLE) AS prior FROM filled GROUP BY y),
l AS (SELECT subject, k, sum(-0.5 * (ln(2 * pi() * v) + (value - a) * (value - a) / v)) + any_value(prior) AS l FROM filled JOIN s USING (feature) JOIN p USING (k) GROUP BY ALL),
x AS (SELECT subject, k, exp(l - max(l) OVER (PARTITION BY subject)) AS x FROM l)
SELECT subject, {", ".join(_r(f"coalesce(sum(x) FILTER (WHERE k = {k}), 0) / sum(x)", f"p{k}") for k in range(3))} FROM x GROUP BY subject""",
}


def _offset_figures(grid: str, cases: str = "said") -> str:
    """SQL of the figures of all (i, a, b) of ``grid``, as ``fig``."""
    counts = _counts("pred", "i, a, b")
    return f"""
logs AS (SELECT y, ln(least(greatest(p0, 1e-12), 1)) AS l0, ln(least(greatest(p1, 1e-12), 1)) AS l1, ln(least(greatest(p2, 1e-12), 1)) AS l2 FROM {cases}),
shifted AS (SELECT i, a, b, y, l0, l1 + a AS l1, l2 + b AS l2 FROM logs, {grid}),
pred AS (SELECT i, a, b, y, CASE WHEN l0 = greatest(l0, l1, l2) THEN 0 WHEN l1 = greatest(l0, l1, l2) THEN 1 ELSE 2 END AS predicted FROM shifted),
counts AS ({counts}),
fig AS (
  SELECT i, a, b, {_FIG["macro_recall"]} AS macro_recall, least({_FIG["recall_0"]}, {_FIG["recall_1"]}, {_FIG["recall_2"]}) AS min_recall,
    {_FIG["macro_f1"]} AS macro_f1, {_FIG["accuracy"]} AS accuracy,
    sqrt(power((a + b) / 3, 2) + power(a - (a + b) / 3, 2) + power(b - (a + b) / 3, 2)) AS norm FROM counts)"""


_BEST = "round(macro_recall, 12) DESC, round(min_recall, 12) DESC, round(macro_f1, 12) DESC, round(norm, 12)"
_FIRST_STEP = _offset_figures("wide")
_SECOND_STEP = _offset_figures("fine").replace("logs AS", "logs2 AS").replace("FROM logs,", "FROM logs2,").replace("shifted", "shifted2").replace("pred AS", "pred2 AS").replace("FROM pred ", "FROM pred2 ").replace("counts AS", "counts2 AS").replace("FROM counts)", "FROM counts2)").replace("fig AS", "fig2 AS")
ORACLE_SQL["two_step_policy"] = f"""
WITH {_SCORES},
wide AS (SELECT CAST(25 * x.i + z.i AS INTEGER) AS i, (-4 + x.i / 3.0::DOUBLE) AS a, (-4 + z.i / 3.0::DOUBLE) AS b FROM range(25) x(i), range(25) z(i)), {_FIRST_STEP},
best AS (SELECT a AS ca, b AS cb FROM fig ORDER BY {_BEST}, i DESC LIMIT 1),
fine AS (
  SELECT CAST(15 * x.i + z.i AS INTEGER) AS i, (-0.35::DOUBLE + 0.05::DOUBLE * x.i) + ca AS a, (-0.35::DOUBLE + 0.05::DOUBLE * z.i) + cb AS b FROM range(15) x(i), range(15) z(i), best
  UNION ALL SELECT 225, ca, cb FROM best), {_SECOND_STEP}
SELECT i, {', '.join(_r(c, c) for c in ('a', 'b', 'macro_recall', 'min_recall', 'macro_f1', 'accuracy', 'norm'))} FROM fig2 ORDER BY {_BEST}, i DESC LIMIT 1"""
ORACLE_SQL["breakpoints"] = f"""
WITH {_SCORES}, v AS (SELECT DISTINCT round(p0 + 3e-10, 3) AS v FROM said), n AS (SELECT v, lead(v) OVER (ORDER BY v) AS f FROM v)
SELECT {_r("coalesce((v + f) / 2, v + 1)", "middle")} FROM n UNION ALL SELECT {_r("min(v) - 1", "middle")} FROM v"""
ORACLE_SQL["breakpoint_policy"] = f"""
WITH {_SCORES}, w AS (SELECT id % 125 AS key, avg(p0) AS a, avg(p1) AS b, avg(p2) AS c FROM said GROUP BY ALL),
pooled AS (SELECT CAST(key % 3 AS INTEGER) AS y, round(a / (a + b + c) + 3e-10, 4) AS p0, round(b / (a + b + c) + 3e-10, 4) AS p1, round(c / (a + b + c) + 3e-10, 4) AS p2 FROM w),
start AS (SELECT 0 AS i, 0.25::DOUBLE AS a, -0.25::DOUBLE AS b), {_offset_figures("start", "pooled")},
lv AS (SELECT y, l0 - l2 AS u, l1 - l2 AS v FROM logs),
x AS (SELECT DISTINCT s.u - t.v AS x FROM lv s, lv t),
m AS (SELECT coalesce((x + lead(x) OVER (ORDER BY x)) / 2, x + 1) AS a FROM x UNION ALL SELECT min(x) - 1 FROM x),
steps AS (
  SELECT a, greatest(u, v + a) AS top, count(*) FILTER (WHERE y = 0) AS y0, count(*) FILTER (WHERE y = 1) AS y1, count(*) FILTER (WHERE y = 2) AS y2,
    count(*) FILTER (WHERE y = 0 AND u >= v + a) AS h0, count(*) FILTER (WHERE y = 1 AND NOT u >= v + a) AS h1, count(*) FILTER (WHERE u >= v + a) AS c0, count(*) FILTER (WHERE NOT u >= v + a) AS c1
  FROM m, lv GROUP BY ALL),
t AS (
  SELECT a, top, coalesce((top + lead(top) OVER o) / 2, top + 1) AS b, row_number() OVER o AS k, {", ".join(f"sum({c}) OVER p AS {c}a, sum({c}) OVER o AS {c}b" for c in ("y0", "y1", "y2", "h0", "h1", "c0", "c1"))}
  FROM steps WINDOW o AS (PARTITION BY a ORDER BY top), p AS (PARTITION BY a)),
points AS (
  SELECT a, b, y0a, y1a, y2a, h0a - h0b AS h0, h1a - h1b AS h1, y2b AS h2, c0a - c0b AS c0, c1a - c1b AS c1, c0b + c1b AS c2 FROM t
  UNION ALL SELECT a, top - 1, y0a, y1a, y2a, h0a, h1a, 0, c0a, c1a, 0 FROM t WHERE k = 1),
found AS (
  SELECT a, b, (h0 / y0a::DOUBLE + h1 / y1a::DOUBLE + h2 / y2a::DOUBLE) / 3 AS macro_recall, least(h0 / y0a::DOUBLE, h1 / y1a::DOUBLE, h2 / y2a::DOUBLE) AS min_recall,
    (2 * h0 / (c0 + y0a)::DOUBLE + 2 * h1 / (c1 + y1a)::DOUBLE + 2 * h2 / (c2 + y2a)::DOUBLE) / 3 AS macro_f1,
    sqrt(power((a + b) / 3, 2) + power(a - (a + b) / 3, 2) + power(b - (a + b) / 3, 2)) AS norm, 1 AS searched FROM points
  UNION ALL SELECT a, b, macro_recall, min_recall, macro_f1, norm, 0 FROM fig)
SELECT {', '.join(_r(c, c) for c in ('a', 'b', 'macro_recall', 'min_recall', 'macro_f1', 'norm'))} FROM found ORDER BY {_BEST}, searched DESC, a DESC, b DESC LIMIT 1"""
ORACLE_SQL["breakpoint_policy_whole"] = ORACLE_SQL["breakpoint_policy"].replace("id % 125 AS key", "id // 4 AS key")
ORACLE_SQL["blend_grid"] = f"""
WITH raw AS (SELECT {_Y} AS y, {", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(("a0", "a1", "a2", "b0", "b1", "b2")))} FROM embeddings),
g AS (
  SELECT CAST(9 * w + 3 * s + t AS INTEGER) AS i, w * 0.25::DOUBLE AS weight, (s - 1) * 0.2::DOUBLE AS s, (t - 1) * 0.2::DOUBLE AS t FROM range(5) x(w), range(3) z(s), range(3) q(t)),
o AS (SELECT i, weight, 0 - (s + t) / 3 AS o0, s - (s + t) / 3 AS o1, t - (s + t) / 3 AS o2 FROM g),
z AS (SELECT y, i, weight, o0, o1, o2, {", ".join(f"weight * a{k} + (1 - weight) * b{k} + o{k} AS z{k}" for k in range(3))} FROM raw, o),
ex AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM z),
p AS (SELECT *, CASE WHEN e0 = greatest(e0, e1, e2) THEN 0 WHEN e1 = greatest(e0, e1, e2) THEN 1 ELSE 2 END AS predicted, CASE y WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END / (e0 + e1 + e2) AS own FROM ex),
c AS ({_counts("p", "i, weight, o0, o1, o2")}), l AS (SELECT i, -avg(ln(own)) AS log_loss FROM p GROUP BY i),
f AS (SELECT i, weight, o0, o1, o2, {_FIG["macro_f1"]} AS macro_f1, {_FIG["macro_recall"]} AS macro_recall, log_loss, sqrt(o0 * o0 + o1 * o1 + o2 * o2) AS norm FROM c JOIN l USING (i)),
best AS (SELECT i AS best FROM f ORDER BY round(macro_f1, 12) DESC, round(log_loss, 12), round(norm, 12), weight, i LIMIT 1)
SELECT i, {', '.join(_r(c, c) for c in ('weight', 'o0', 'o1', 'o2', 'macro_f1', 'macro_recall', 'log_loss', 'norm'))}, i = best AS selected FROM f, best"""
ORACLE_SQL["bootstrap_percentiles"] = ORACLE_SQL["bootstrap_interval"].replace("range(100)", "range(2000)")
_U = [f"({_hash48(f"'{SEED}:' || i || ':{j}'")} / 281474976710656.0::DOUBLE)" for j in range(4)]
ORACLE_SQL["recipe_search"] = f"""
WITH {_SCORES}, u AS (SELECT CAST(i AS INTEGER) AS i, i % 4 = 0 AS flat, {", ".join(f"{u} AS u{j}" for j, u in enumerate(_U))} FROM range(200) r(i)),
g AS (
  SELECT i, flat, exp(2.4 * u0 - 1.2) AS t0, exp(2.4 * u1 - 1.2) AS t1, CASE WHEN flat THEN 2.4 * u1 - 1.2 ELSE 3 * u2 - 1.5 END AS b0, CASE WHEN flat THEN 2.4 * u2 - 1.2 ELSE 3 * u3 - 1.5 END AS b1 FROM u),
z AS (
  SELECT i, flat, y, exp(ln(p0) / t0) AS f0, exp(ln(p1) / t0 + b0) AS f1, exp(ln(p2) / t0 + b1) AS f2,
    1 / (1 + exp(-(ln(p2 / (1 - p2)) / t0 + b0))) AS d, 1 / (1 + exp(-(ln(p1 / (1 - p1)) / t1 + b1))) AS q FROM said, g),
s AS (
  SELECT i, flat, y, CASE WHEN flat THEN f0 / (f0 + f1 + f2) ELSE (1 - d) * (1 - q) END AS p0, CASE WHEN flat THEN f1 / (f0 + f1 + f2) ELSE (1 - d) * q END AS p1,
    CASE WHEN flat THEN f2 / (f0 + f1 + f2) ELSE d END AS p2 FROM z),
t AS (SELECT *, CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1 ELSE 2 END AS predicted FROM s),
c AS ({_counts("t", "i, flat")}),
ovr AS ({" UNION ALL ".join(f"SELECT i, {k} AS class, round(p{k}, 9) AS score, CAST(y = {k} AS BIGINT) AS hit FROM s" for k in range(3))}),
steps AS (SELECT i, class, score, sum(hit) AS hits, sum(1 - hit) AS misses FROM ovr GROUP BY ALL),
run AS (SELECT *, sum(misses) OVER (PARTITION BY i, class ORDER BY score DESC) AS fp, sum(hits) OVER (PARTITION BY i, class) AS pos, sum(misses) OVER (PARTITION BY i, class) AS neg FROM steps),
a AS (SELECT i, avg(auc) AS auc FROM (SELECT i, class, sum(hits * (neg - fp + misses / 2.0)) / (max(pos) * max(neg))::DOUBLE AS auc FROM run GROUP BY ALL) GROUP BY i),
r AS (SELECT i, flat, auc, {_FIG["macro_recall"]} AS macro_recall, {_FIG["macro_f1"]} AS macro_f1 FROM c JOIN a USING (i)),
o AS (SELECT *, CASE WHEN auc >= 0.8 AND macro_recall >= 0.8 THEN 1 ELSE 0 END + least(auc, macro_recall) + 0.02 * (auc + macro_recall) / 2 + 0.001 * macro_f1 AS objective FROM r)
SELECT i, flat, {', '.join(_r(c, c) for c in ('auc', 'macro_recall', 'macro_f1', 'objective'))} FROM o ORDER BY round(objective, 9) DESC, i LIMIT 20"""
