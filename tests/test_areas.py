import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from diurna.operators import areas, folds, learners, policy


def plain_auc(y, p):
    out = []
    for k in range(3):
        a, b = p[y == k, k], p[y != k, k]
        if len(a) and len(b):
            out.append(((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b)))
    return np.mean(out)


def test_areas_of_many_sets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], (4, 90)).round(2)  # with ties, zeros and ones
    p[0, 0], p[1, 1] = [0, 0, 1], [1, 0, 0]
    y = rng.integers(0, 3, (4, 90))
    y[3] = 1  # no class has both
    rows = [(s, int(y[s, i]), *map(float, p[s, i])) for s in range(4) for i in range(90)]
    said = spark.createDataFrame(rows, "key int, y int, p0 double, p1 double, p2 double")
    for n in (90, 40 * areas.STRETCH):  # one stretch, and many
        got = {r["key"]: r["auc"] for r in areas.mean_auc(areas.packed(said.repartition(5), n)).collect()}
        assert len(got) == 4 and got[3] is None
        for s in range(3):
            assert got[s] == pytest.approx(plain_auc(y[s], p[s]), abs=1e-12)


def test_recipes_are_scored_in_tasks(spark):
    """No plan has a row for each case and recipe: before, 300 cases by 2,500 recipes were 750,000."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([2, 2, 2], 300)
    scores = spark.createDataFrame([(int(i % 3), *map(float, r)) for i, r in enumerate(p)], "y int, p0 double, p1 double, p2 double")
    got = policy.recipe_search(scores, 40, 5, 40).collect()
    recipes = {r["i"]: r for r in spark.range(1).select(F.explode(policy.random_recipes(40, 5)).alias("r")).select("r.*").collect()}
    y = np.arange(300) % 3
    assert len(got) == 40
    for r in got:
        d = recipes[r["i"]]
        if d["flat"]:
            q = np.exp(np.log(p) / d["t0"] + [0, d["b0"], d["b1"]])
        else:
            last, inner = (1 / (1 + np.exp(-(np.log(p[:, k] / (1 - p[:, k])) / t + b))) for k, t, b in ((2, d["t0"], d["b0"]), (1, d["t1"], d["b1"])))
            q = np.stack([(1 - last) * (1 - inner), (1 - last) * inner, last], 1)
        q = q / q.sum(1, keepdims=True)
        assert r["auc"] == pytest.approx(plain_auc(y, q.round(9)), abs=1e-9)
        assert r["macro_recall"] == pytest.approx(np.mean([(q[y == k].argmax(1) == k).mean() for k in range(3)]))


def test_permuted_matrices_equal_permuted_tables(spark):
    rng = np.random.default_rng(1)
    y = np.arange(60) % 3
    x = rng.normal(size=(60, 3)) + 2 * np.eye(3)[y]
    long = spark.createDataFrame([(i, int(y[i]), f, float(x[i, f])) for i in range(60) for f in range(3)], "subject long, y int, feature int, value double")
    fast = learners.discriminant(learners.vectors(long, [0, 1, 2]))
    asked = []

    def slow(rows):
        asked.append(rows)
        return fast(rows)

    for groups in (None, {"a": [0, 2], "b": [1]}):
        out = []
        for score in (fast, slow):
            rows = learners.permutation_importance(score, long, [0, 1, 2], 3, 4, groups).collect()
            out.append({(r["feature"], r["repeat"]): r["drop"] for r in rows})
        assert len(out[0]) == 3 * (3 if groups is None else 2) and out[0] == pytest.approx(out[1], abs=1e-12)
    assert hasattr(fast, "proba") and len(asked) == 4


def test_permutations_go_in_waves(spark, monkeypatch):
    """A wave's shuffles are gone before the next one's areas; before, those of all repeats stayed on disk."""
    rng = np.random.default_rng(4)
    n, repeats = 2400, 3
    y = np.arange(n) % 3
    x = rng.normal(size=(n, 2)) + np.eye(3)[y][:, :2]
    long = spark.createDataFrame([(i, int(y[i]), f, float(x[i, f])) for i in range(n) for f in range(2)], "subject long, y int, feature int, value double").cache()
    score = learners.discriminant(learners.vectors(long, [0, 1]))

    def on_disk():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))

    def run():
        return {(r["feature"], r["repeat"]): r["drop"] for r in learners.permutation_importance(score, long, [0, 1], repeats, 3).collect()}

    whole = run()
    assert len(whole) == 2 * repeats and min(whole.values()) > 0.01
    sizes, areas_of = [], learners.mean_auc

    def watched(some):
        time.sleep(0.5)  # files go a little after their action
        sizes.append(on_disk())
        return areas_of(some)

    monkeypatch.setattr(learners, "mean_auc", watched)
    monkeypatch.setattr(learners, "SENT", n * 3 * 2, raising=False)
    assert run() == pytest.approx(whole, abs=1e-12)
    sizes.append(on_disk())
    assert len(sizes) == repeats + 2  # the scores without permutation, then one repeat a wave
    assert max(sizes[2:]) < sizes[1] + 8 * n * 3 * 2  # no more than one wave's scores
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    monkeypatch.setattr(areas, "STRETCH", 700)  # scores cut into stretches
    assert run() == pytest.approx(whole, abs=1e-12)
    long.unpersist()


def test_neighbours_among_copies(spark):
    """Equal distances go to the least neighbour; blocks of a class are no more than SPLITS until a block is full."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(12, 5)), 5, 0)  # five copies of each
    ids = rng.permutation(60)
    rows = spark.createDataFrame([(int(s), 0, list(map(float, v))) for s, v in zip(ids, x, strict=True)], "subject long, y int, x array<double>")
    data = rows.select("subject", "y", array_to_vector("x").alias("features"))
    for block in (2, 7, 100):
        got = {(r["subject"], r["rank"]): r["neighbour"] for r in learners.neighbours(data, 7, block).collect()}
        assert len(got) == 7 * 60
        for i, s in enumerate(ids):
            d = [(float(np.sqrt(((x[i] - z) ** 2).sum())), int(t)) for t, z in zip(ids, x, strict=True) if t != s]
            assert [got[s, r] for r in range(7)] == [t for _, t in sorted(d)[:7]]


def test_bootstrap_over_pages(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(folds, "PAGE", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    cases = [(i, i % 2, i % 7) for i in range(31)]
    df = folds.bootstrap(spark.createDataFrame(cases, "id long, y int, predicted int"), 4, 9)
    ranked = {y: [p for _, p in sorted((hashlib.md5(f"9:{i}".encode()).hexdigest(), p) for i, c, p in cases if c == y)] for y in (0, 1)}
    draw = lambda r, y, i: ranked[y][int(hashlib.md5(f"9:{r}:{y}:{i}".encode()).hexdigest()[:12], 16) % len(ranked[y])]
    want = sorted((r, y, draw(r, y, i + 1)) for r in range(4) for y in (0, 1) for i in range(len(ranked[y])))
    assert sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan  # draws stay where they are made


def test_folds_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, i % 3, [float(i % 3), float(i % 5)]) for i in range(30)], "subject long, y int, x array<double>")
    data = rows.mapInArrow(passed, rows.schema).select("subject", "y", array_to_vector("x").alias("features"))
    dealt = rows.select("subject", (F.col("subject") % 3).cast("int").alias("fold"))
    assert learners.out_of_fold(learners.logistic(1.0), data, dealt, 3).count() == 30
    assert seen.value == 30
