"""Queries of relational and record operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import argmax, clip_scores, expit, logit
from ..operators import folds, records
from . import bindings as b
from .model_queries import _SCORES, SEED, _hash48
from .signal_queries import _corr, _r, rounded


def labelled_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers of one segment, without those of one nation."""
    o, c = b.table(spark, sf_dir, "orders"), b.table(spark, sf_dir, "customer")
    kept = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    dropped = c.filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    out = o.join(kept, "o_custkey", "left_semi").join(dropped, "o_custkey", "left_anti")
    return rounded(out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))


def subject_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, difference and concatenation of two sets of parts."""
    l = b.table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = l.filter("l_quantity < 10").select("l_partkey"), l.filter("l_quantity > 40").select("l_partkey")
    parts = {"union": x.union(y).distinct(), "intersect": x.intersect(y), "except": x.distinct().exceptAll(y.distinct()), "concat": x.union(y)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


def first_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of the line items by their first order."""
    return records.ordered_distinct(b.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey"), "l_partkey", "l_orderkey")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("auc"), F.avg("l_tax").alias("recall"))
    return s.select(F.col("l_suppkey").alias("name"), F.floor(F.col("l_suppkey") / 2).cast("long").alias("parent"), (F.col("l_suppkey") % 7).alias("stage"), "auc", "recall")


def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    out = records.parent_deltas(r, "name", "parent", ["auc", "recall"])
    ref = records.reference_deltas(r, "name", 1, ["auc"]).select("name", F.col("delta_auc").alias("reference_delta"))
    return rounded(out.join(ref, "name", "left"))


def stage_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best record of each stage, and the ten best of all."""
    r = _records(spark, sf_dir)
    best = records.best_per(r, ["stage"], [F.round("auc", 10).desc(), F.col("name")]).withColumn("kind", F.lit("stage"))
    top = r.orderBy(F.round("auc", 10).desc(), "name").limit(10).withColumn("kind", F.lit("top"))
    return rounded(best.unionByName(top))


def _importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.matrix(spark, sf_dir).filter("value is not null")
    return m.select("feature", (F.col("subject") % 5).alias("fold"), "y", "value")


def importance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability over folds, by feature."""
    return rounded(records.fold_stability(_importances(spark, sf_dir), "feature", "fold", "value", 5))


def importance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.range(60).select(F.col("id").cast("int").alias("feature"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("modality"), (F.col("id") % 3).cast("int").alias("family"))
    return rounded(records.grouped_importance(_importances(spark, sf_dir), meta, "feature", "value", ["modality", "family"]))


def importance_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _importances(spark, sf_dir).groupBy("feature", "y").agg(F.avg("value").alias("v")).filter("feature % 3 <> y")
    by = by.withColumn("w", F.when(F.col("y") == 0, 0.5).when(F.col("y") == 1, 0.3).otherwise(0.2))
    return rounded(records.consensus(by, "y", "feature", "v", "w"))


def direction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign of a feature's correlation with the class, in each fold."""
    rows = _importances(spark, sf_dir).withColumn("y", F.col("y").cast("double"))
    return rounded(records.direction(rows, ["feature", "fold"], "value", "y"))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.scores(spark, sf_dir).withColumn("predicted", argmax([F.col("p0"), F.col("p1"), F.col("p2")]))


def reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against themselves with a small change of every fiftieth."""
    s = _said(spark, sf_dir)
    other = s.withColumn("p0", F.when(F.col("id") % 50 == 0, F.col("p0") / 2).otherwise(F.col("p0")))
    other = other.withColumn("predicted", argmax([F.col("p0"), F.col("p1"), F.col("p2")]))
    return rounded(records.agreement(s, other, "id", ["p0", "p1", "p2"], "predicted"))


def hierarchical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impaired or not, then which: [1-i, i(1-d), i d]; and a logit blend."""
    i, d = F.col("p1"), F.col("p2")
    s = b.scores(spark, sf_dir)
    h = clip_scores([1 - i, i * (1 - d), i * d])
    blend = expit(0.25 * logit(i) + 0.75 * logit(d))
    return rounded(s.select("id", *[c.alias(f"h{k}") for k, c in enumerate(h)], blend.alias("blend")))


def prior_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class frequencies of each fold's training subjects, as scores of its test subjects."""
    s = b.scores(spark, sf_dir).select(F.col("id").alias("subject"), "y")
    f = folds.group_folds(s, 5, SEED)
    rows = f.withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("fold <> test")
    prior = rows.groupBy("test").agg(*[F.avg((F.col("y") == k).cast("double")).alias(f"p{k}") for k in range(3)])
    return rounded(f.select("subject", "y", F.col("fold").alias("test")).join(F.broadcast(prior), "test"))


def label_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states of customers from two tables, in any case and spacing."""
    c = b.table(spark, sf_dir, "customer")
    name = F.when(F.col("c_nationkey") % 3 == 0, "cn").when(F.col("c_nationkey") % 3 == 1, " Mci ").otherwise("DEM")
    one = c.select(F.sha2(F.lower(F.trim(F.col("c_custkey").cast("string"))), 256).alias("subject"), name.alias("label"))
    return records.reconcile_labels([one, one.filter("subject < '8'")], ["CN", "MCI", "DEM"])


def cohort_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of days per user over 16 bins."""
    d = b.daily(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    r = d.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    at = F.least(F.lit(15), F.floor((F.col("n") - F.col("lo")) * 16 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))).cast("int"))
    return d.join(F.broadcast(r)).select(F.coalesce(at, F.lit(0)).alias("bin"), "n").groupBy("bin").agg(F.count(F.lit(1)).alias("users"), F.min("n").alias("least"), F.max("n").alias("most"))


def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, unusable dates, repeats and kept rows of orders by status."""
    o = b.table(spark, sf_dir, "orders").withColumn("date", F.when(F.col("o_orderkey") % 97 != 0, F.to_date("o_orderdate")))
    by = o.groupBy("o_orderstatus", "o_custkey", "date").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("o_orderstatus").agg(
        F.sum("n").alias("input_rows"),
        F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("n"))), F.lit(0)).alias("bad_dates"),
        F.sum(F.when(F.col("date").isNotNull(), F.col("n") - 1)).alias("duplicate_subject_dates"),
        F.count(F.when(F.col("date").isNotNull(), F.lit(1))).alias("kept_rows"),
        F.count_distinct(F.when(F.col("date").isNotNull(), F.col("o_custkey"))).alias("subjects"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        labelled_only, subject_sets, first_places, ablation_deltas, stage_best, importance_summary, importance_groups, importance_consensus,
        direction_agreement, reproduction, hierarchical_scores, prior_baseline, label_reconciliation, cohort_profile, ingest_audit,
    )
}

_RECORDS = """
r AS (
  SELECT l_suppkey AS name, CAST(floor(l_suppkey / 2) AS BIGINT) AS parent, l_suppkey % 7 AS stage, avg(l_discount) AS auc, avg(l_tax) AS recall
  FROM lineitem GROUP BY l_suppkey)"""
_IMP = """
i AS (
  SELECT CAST(f AS INTEGER) AS feature, vec_id % 5 AS fold, CASE WHEN label <= 5 THEN 0 WHEN label <= 8 THEN 1 ELSE 2 END AS y, v AS value FROM (
    SELECT vec_id, label, unnest(range(len(embedding))) AS f, unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE (vec_id + f) % 17 <> 0)"""


def _lg(p: str) -> str:
    q = f"least(greatest({p}, 1e-9), 1 - 1e-9)"
    return f"ln({q} / (1 - {q}))"


ORACLE_SQL = {
    "labelled_only": f"""
SELECT o_custkey, count(*) AS n, {_r("sum(o_totalprice)", "total")} FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY o_custkey""",
    "subject_sets": """
WITH x AS (SELECT l_partkey FROM lineitem WHERE l_quantity < 10), y AS (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)
SELECT 'union' AS op, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS total FROM (FROM x UNION FROM y) UNION ALL
SELECT 'intersect', count(*), CAST(sum(l_partkey) AS BIGINT) FROM (FROM x INTERSECT FROM y) UNION ALL
SELECT 'except', count(*), CAST(sum(l_partkey) AS BIGINT) FROM (FROM x EXCEPT FROM y) UNION ALL
SELECT 'concat', count(*), CAST(sum(l_partkey) AS BIGINT) FROM (FROM x UNION ALL FROM y)""",
    "first_places": "SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey",
    "ablation_deltas": f"""
WITH {_RECORDS} SELECT r.name, r.parent, r.stage, {_r("r.auc", "auc")}, {_r("r.recall", "recall")}, {_r("r.auc - p.auc", "delta_auc")}, {_r("r.recall - p.recall", "delta_recall")},
  {_r("r.auc - (SELECT auc FROM r WHERE name = 1)", "reference_delta")} FROM r LEFT JOIN r p ON r.parent = p.name""",
    "stage_best": f"""
WITH {_RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY round(auc, 10) DESC, name) AS i, row_number() OVER (ORDER BY round(auc, 10) DESC, name) AS j FROM r)
SELECT name, parent, stage, {_r("auc", "auc")}, {_r("recall", "recall")}, 'stage' AS kind FROM k WHERE i = 1 UNION ALL
SELECT name, parent, stage, {_r("auc", "auc")}, {_r("recall", "recall")}, 'top' FROM k WHERE j <= 10""",
    "importance_summary": f"""
WITH {_IMP}, f AS (SELECT feature, fold, avg(abs(value)) AS v FROM i GROUP BY ALL)
SELECT feature, {_r("avg(v)", "mean")}, {_r("coalesce(stddev_samp(v), 0)", "std")}, {_r("count(*) FILTER (WHERE v > 1e-10) / 5.0::DOUBLE", "nonzero_folds")} FROM f GROUP BY feature""",
    "importance_groups": f"""
WITH {_IMP} SELECT CASE WHEN feature < 60 THEN CASE WHEN feature % 2 = 0 THEN 'even' ELSE 'odd' END END AS modality, CASE WHEN feature < 60 THEN CAST(feature % 3 AS INTEGER) END AS family,
  {_r("sum(value)", "sum")}, {_r("avg(value)", "mean")}, count(*) AS n FROM i GROUP BY 1, 2""",
    "importance_consensus": f"""
WITH {_IMP}, v AS (SELECT feature, y, avg(value) AS v FROM i WHERE feature % 3 <> y GROUP BY ALL),
s AS (SELECT feature, y, abs(v) / sum(abs(v)) OVER (PARTITION BY y) AS s FROM v)
SELECT feature, {_r("sum(s * CASE y WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END)", "consensus")}, count(DISTINCT y) AS branches FROM s GROUP BY feature""",
    "direction_agreement": f"WITH {_IMP}, d AS (SELECT feature, fold, value, CAST(y AS DOUBLE) AS z FROM i) SELECT feature, fold, CAST(sign({_corr('value', 'z', 4)}) AS DOUBLE) AS direction FROM d GROUP BY feature, fold",
    "reproduction": f"""
WITH {_SCORES}, o AS (SELECT id, predicted, p0, CASE WHEN id % 50 = 0 THEN p0 / 2 ELSE p0 END AS q0, p1, p2 FROM said),
t AS (SELECT *, CASE WHEN q0 = greatest(q0, p1, p2) THEN 0 WHEN p1 = greatest(q0, p1, p2) THEN 1 ELSE 2 END AS q FROM o)
SELECT count(*) AS n, {_r("max(abs(p0 - q0))", "max_abs_diff")}, {_r("avg(CASE WHEN predicted = q THEN 1.0 ELSE 0.0 END::DOUBLE)", "match_rate")} FROM t""",
    "hierarchical_scores": f"""
WITH {_SCORES} SELECT id, {_r("1 - p1", "h0")}, {_r("p1 * (1 - p2)", "h1")}, {_r("p1 * p2", "h2")}, {_r(f"1 / (1 + exp(-(0.25 * {_lg('p1')} + 0.75 * {_lg('p2')})))", "blend")} FROM said""",
    "prior_baseline": f"""
WITH {_SCORES}, f AS (SELECT id AS subject, y, {_hash48(f"'{SEED}:' || id")} % 5 AS fold FROM said),
p AS (SELECT t AS test, {", ".join(f"avg(CASE WHEN y = {k} THEN 1.0 ELSE 0.0 END::DOUBLE) AS p{k}" for k in range(3))} FROM f, range(5) r(t) WHERE fold <> t GROUP BY t)
SELECT CAST(test AS INTEGER) AS test, subject, y, {", ".join(_r(f"p{k}", f"p{k}") for k in range(3))} FROM f JOIN p ON f.fold = p.test""",
    "label_reconciliation": "SELECT sha256(c_custkey::VARCHAR) AS subject, CASE c_nationkey % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'MCI' ELSE 'DEM' END AS label FROM customer",
    "cohort_profile": """
WITH d AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY user_id), r AS (SELECT min(n) AS lo, max(n) AS hi FROM d)
SELECT CAST(coalesce(least(15, floor((n - lo) * 16 / nullif(hi - lo, 0)::DOUBLE)), 0) AS INTEGER) AS bin, count(*) AS users, min(n) AS least, max(n) AS most FROM d, r GROUP BY 1""",
    "ingest_audit": """
WITH o AS (SELECT o_orderstatus, o_custkey, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders),
b AS (SELECT o_orderstatus, o_custkey, date, count(*) AS n FROM o GROUP BY ALL)
SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS input_rows, CAST(coalesce(sum(n) FILTER (WHERE date IS NULL), 0) AS BIGINT) AS bad_dates,
  CAST(sum(n - 1) FILTER (WHERE date IS NOT NULL) AS BIGINT) AS duplicate_subject_dates, count(*) FILTER (WHERE date IS NOT NULL) AS kept_rows,
  count(DISTINCT o_custkey) FILTER (WHERE date IS NOT NULL) AS subjects FROM b GROUP BY o_orderstatus""",
}
