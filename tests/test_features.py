import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from diurna.functions import scalars
from diurna.operators import features, learners, matrix, metrics, records


def test_normal_quantile(spark):
    ps = [1e-7, 1e-4, 0.02, 0.02425, 0.1, 0.5, 0.77, 0.97575, 0.99, 1 - 1e-7]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", scalars.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(math.isclose(r["z"], NormalDist().inv_cdf(r["p"]), rel_tol=2e-9, abs_tol=2e-9) for r in got)


def test_quantile_scale_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    train = np.round(rng.normal(size=60), 1)  # with ties
    test = np.concatenate([train[:20], rng.normal(size=30), [-9.0, 9.0]])
    rows = lambda v: spark.createDataFrame([(i, 7, float(x)) for i, x in enumerate(v)], "subject int, feature int, value double")
    got = [r["value"] for r in features.quantile_scale(rows(test), features.fit_quantiles(rows(train))).orderBy("subject").collect()]
    q, at = np.quantile(train, np.linspace(0, 1, 60)), np.linspace(0, 1, 60)
    p = 0.5 * (np.interp(test, q, at) - np.interp(-test, -q[::-1], -at[::-1]))
    p[test <= q[0]], p[test >= q[-1]] = 0, 1
    want = [NormalDist().inv_cdf(x) for x in np.clip(p, 1e-7, 1 - 1e-7)]
    assert np.allclose(got, want, atol=1e-6)


META = [
    ("v3__activity__low__std", "activity", "physiology"), ("activity__low__extra_std", "activity", "physiology"), ("sleep__score__median", "sleep", "vendor"),
    ("v3__sleep__paper_hr_drop__stv7", "sleep", "physiology"), ("coupling__steps_next__n_pairs", "coupling", "quality"), ("activity__first_day", "activity", "collection_context"),
    ("sleep__standard__median", "sleep", "physiology"),
]


def test_views(spark):
    meta = spark.createDataFrame(META, "feature string, modality string, family string")
    got: dict = {}
    for r in features.view_features(meta).collect():
        got.setdefault(r["view"], set()).add(r["feature"])
    names = [m[0] for m in META]
    assert got["all"] == set(names) and got["temporal"] == {names[0], names[3]}
    assert got["variability"] == {names[0], names[3]} and "sleep__standard__median" not in got["variability"]
    assert got["dem_single"] == {"v3__activity__low__std"} and got["legacy"] == {names[1], names[2], names[4], names[6]}
    assert got["unscored"] == set(names) - {names[2], names[4]} and got["context_only"] == {names[5]}
    rest = features.view_features(meta.filter("feature <> 'v3__activity__low__std'"), ["dem_single"]).collect()
    assert [r["feature"] for r in rest] == ["activity__low__extra_std"]
    with pytest.raises(ValueError, match="unknown views"):
        features.view_features(meta, ["everything"])


def test_tasks(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(18)], "subject int, y int")
    assert features.task_rows(rows, "dem").count() == 18 and features.task_rows(rows, "dem").filter("y = 1").count() == 6
    assert features.task_rows(rows, "cn_mci").count() == 12
    with pytest.raises(ValueError):
        features.task_rows(rows, "x")


def test_training_checks(spark):
    good = spark.createDataFrame([(i, i % 3, float(i), None) for i in range(6)], "subject int, y int, f double, g double")
    assert features.check_training(good, ["f", "g"]) is good
    for bad, names, says in (
        (good, ["f", "f"], "repeated"), (good.withColumn("g", F.lit("x")), ["f", "g"], "numeric"), (good.unionByName(good.limit(1)), ["f"], "repeat"), (good.filter("y < 2"), ["f"], "labels"),
        (good.withColumn("y", F.col("y") + 1), ["f"], "labels"), (good.withColumn("f", F.lit(float("inf"))), ["f"], "infinite"), (good.withColumnRenamed("f", "MMSE_total"), ["MMSE_total"], "forbidden"),
    ):
        with pytest.raises(ValueError, match=says):
            features.check_training(bad, names)
    floats = features.as_floats(spark.createDataFrame([(float("nan"), 1.5), (float("inf"), None)], "a double, b double"), ["a", "b"])
    assert [tuple(r) for r in floats.collect()] == [(None, 1.5), (None, None)] and dict(floats.dtypes)["a"] == "float"


def test_joins_and_fingerprints(spark):
    x = spark.createDataFrame([(1, 0.5), (2, None), (2, None)], "k int, v double")
    y = spark.createDataFrame([(1, 0), (2, 1)], "k int, y int")
    assert features.complete_join(x, y, "k").count() == 3
    with pytest.raises(Exception, match="no label for 2"):
        features.complete_join(x, y.filter("k = 1"), "k").collect()
    one = features.fingerprint(x).first()["digest"]
    assert features.fingerprint(x.orderBy(F.desc("k")).repartition(3)).first()["digest"] == one
    assert features.check_unchanged(x, one) is x
    for other in (x.distinct(), x.fillna(0.0), x.withColumnRenamed("v", "w"), x.limit(0)):
        with pytest.raises(ValueError, match="changed"):
            features.check_unchanged(other, one)


def test_jitter_and_parents(spark):
    data = spark.createDataFrame([(i, int(i > 5), [float(i), 2.0]) for i in range(8)], "subject int, y int, values array<double>")
    made = features.jitter(data, 5)
    rows = made.collect()
    assert [r["y"] for r in rows] == [1] * 4 and {r["parent"] for r in rows} <= {6, 7}
    assert all(0 < abs(r["values"][0] - r["parent"]) < 0.3 and r["values"][1] != 2.0 for r in rows)
    assert features.stray_parents(made, ["parent"], data).count() == 0
    assert features.stray_parents(made, ["parent"], data.filter("subject < 6")).count() > 0


def test_sleep_clock(spark):
    df = spark.sql("SELECT timestamp'2026-01-01 23:30:00' s, timestamp'2026-01-02 07:30:00' e, 1.0 d, 2.0 l, 6.0 t UNION ALL SELECT timestamp'2026-01-02 01:00:00', null, 1.0, 2.0, 0.0")
    c = features.sleep_clock(*[F.col(x) for x in "sedlt"])
    a, b = df.select(*[v.alias(k) for k, v in c.items()]).collect()
    assert (a["bedtime_noon_unwrapped"], a["wake_hour"], a["interval_hours"], a["nrem_fraction"]) == (23.5, 7.5, 8.0, 0.5)
    assert math.isclose(a["midpoint_sin"], math.sin(3.5 * math.pi / 12))
    assert b["bedtime_noon_unwrapped"] == 25.0 and b["interval_hours"] is None and b["nrem_fraction"] is None and b["midpoint_sin"] is None


def test_seeds_and_records(spark, tmp_path):
    s = spark.createDataFrame([(i, seed, 0.1 * seed, 0.5) for i in range(4) for seed in range(3)], "id int, seed int, p0 double, p1 double")
    assert all(math.isclose(r["p0"], 0.1) for r in features.seed_mean(s, "id", "seed", ["p0", "p1"]).collect())
    with pytest.raises(Exception, match="seeds missing for 3"):
        features.seed_mean(s.filter("id < 3 or seed > 0"), "id", "seed", ["p0", "p1"]).collect()
    flat = features.flattened(s.select("id", F.struct("p0", "p1").alias("raw")), ["raw"])
    assert flat.columns == ["id", "raw_p0", "raw_p1"]
    for kind in ("csv", "json", "parquet"):
        features.write_table(flat, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 12
    assert features.branch_candidates(s.selectExpr("id", "seed", "p0"), "seed", "id", "p0", (0, 1), 2).count() == 4
    assert features.readable(F.lit("x")) is not None
    got = spark.range(1).select(features.readable(F.lit("activity__state_code_5_fraction"))).first()[0]
    assert got == "activity__state_5_high_intensity_activity_fraction"


def test_alike_models_over_tasks(spark):
    rows = [(i, m, float(i) + (1e-9 if m == 2 else 0.0) + (1.0 if m == 3 and i == 17 else 0.0)) for i in range(40) for m in range(5)]
    s = spark.createDataFrame(rows, "id int, m int, v double").repartition(7)
    order = spark.createDataFrame([(4,), (0,), (3,), (2,), (1,)], "m int")
    assert records.distinct_predictions(s, "m", "id", "v", order) == [4, 3]


def test_weighted_means(spark):
    s = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, predicted int")
    r = metrics.weighted_means(metrics.report(metrics.confusion(s))).first()
    assert math.isclose(r["weighted_recall"], 0.5) and math.isclose(r["weighted_precision"], (2 * 1.0 + 1 / 3) / 4)


def test_correlation_filter_of_many_features(spark):
    rows = [(s, 0, f, float((s * (f // 2 + 3)) % 11)) for s in range(20) for f in range(40)]
    long = spark.createDataFrame(rows, "subject int, y int, feature int, value double")
    chosen = matrix.correlation_filter(long, list(range(40)), 0.99, 8)
    assert len(chosen) == 8 and all(f % 2 == 0 for f in chosen)
    assert learners.vectors(long, [1, 0]).count() == 20


def _cases(spark, n=240):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(2)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=3) + 2 * np.eye(3)[i % 3]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "subject long, y int, f array<double>").select("subject", "y", array_to_vector("f").alias("features"))


def test_discriminant_equals_plain_algebra(spark):
    import numpy as np

    rows, data = _cases(spark)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    means = np.stack([x[y == k].mean(0) for k in range(3)])
    within = sum((x[y == k] - means[k]).T @ (x[y == k] - means[k]) for k in range(3)) / len(x)
    within = 0.9 * within + 0.1 * np.trace(within) / 3 * np.eye(3)
    w = np.linalg.solve(within, means.T).T
    z = x @ w.T + np.log(1 / 3) - 0.5 * (w * means).sum(1)
    want = np.exp(z - z.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    got = np.array([[r["p0"], r["p1"], r["p2"]] for r in learners.discriminant(data)(data).orderBy("subject").collect()])
    assert np.allclose(got, want, atol=1e-9)


def test_kernel_ridge_learns(spark):
    rows, data = _cases(spark)
    got = learners.kernel_ridge(data.filter("subject % 2 = 0"), gamma=0.1)(data.filter("subject % 2 = 1")).collect()
    assert sum(max(range(3), key=lambda k: r[f"p{k}"]) == r["y"] for r in got) > 0.7 * len(got)


def test_folds_must_be_whole(spark):
    rows, data = _cases(spark, 30)
    folds = spark.createDataFrame([(i, i % 3) for i in range(30)], "subject long, fold int")
    assert learners.out_of_fold(learners.logistic(1.0), data, folds, 3).count() == 30
    for bad in (folds.filter("subject > 0"), folds.unionByName(folds.limit(1))):
        with pytest.raises(Exception, match="no single fold"):
            learners.out_of_fold(learners.logistic(1.0), data, bad, 3).collect()


def test_groups_are_permuted_together(spark):
    rows, data = _cases(spark, 60)
    long = spark.createDataFrame([(i, y, f, x) for i, y, v in rows for f, x in enumerate([*v, 0.5])], "subject long, y int, feature int, value double").filter("subject < 60")
    score = learners.discriminant(learners.vectors(long, [0, 1, 2, 3]))
    drops = learners.permutation_importance(score, long, [0, 1, 2, 3], 6, 1, {"all": [0, 1, 2, 3], "one": [0], "none": [3]})
    out = {r["feature"]: r for r in features.drop_summary(drops, ["feature"]).collect()}
    assert out["all"]["mean"] > out["one"]["mean"] > 0 and abs(out["none"]["mean"]) < 1e-9 and out["all"]["repeats"] == 6
    assert out["all"]["q05"] <= out["all"]["median"] <= out["all"]["q95"] and out["all"]["sd"] > 0
