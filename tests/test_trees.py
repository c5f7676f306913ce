"""Trees against plain builds of the same rules on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import learners, trees

D = 5


def table(spark, n=200, seed=1, missing=0.15, classes=3, weights=True):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, D)), 1)
    x[:, 4] = r.integers(0, 3, n)  # few values, many ties
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * r.normal(size=n) > 0.3).astype(int) + ((x[:, 2] > 0.5) if classes == 3 else 0)
    x[r.random(x.shape) < missing] = np.nan
    x[y == 0, 3] = np.where(r.random((y == 0).sum()) < 0.6, np.nan, x[y == 0, 3])  # missing tells something
    w = r.choice([0.5, 1.0, 2.0], n) if weights else np.ones(n)
    rows = [(i, int(y[i]), float(w[i]), [None if math.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "subject long, y int, weight double, x array<double>").repartition(3), x, y, w


def plain_bins(x, most):
    out = []
    for j in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, j]), j])
        kinds = sorted(set(v))
        if len(kinds) <= most:
            groups = {a: i for i, a in enumerate(kinds)}
        else:
            groups = {a: int(np.searchsorted(v, a, "left")) * most // len(v) for a in kinds}
        names = sorted(set(groups.values()))
        ends = [(min(a for a in kinds if groups[a] == g), max(a for a in kinds if groups[a] == g)) for g in names]
        out.append(np.array([(ends[i][1] + ends[i + 1][0]) / 2 for i in range(len(ends) - 1)]))
    return out


def plain_split(b, rows, g, h, strength, least):
    """The best of all splits of some rows, looked at one by one."""
    best = None
    for f in range(b.shape[1]):
        for cut in sorted(set(b[rows, f]) - {0}):
            for missing_left in (True, False):
                left = [i for i in rows if (missing_left if b[i, f] == 0 else b[i, f] <= cut)]
                right = [i for i in rows if i not in set(left)]
                none = sum(b[i, f] == 0 for i in rows)
                if len(left) < least or len(right) < least or sum(h[left]) < 1e-3 or sum(h[right]) < 1e-3:
                    continue
                if not none and missing_left != (len(left) >= len(right)):
                    continue
                gain = sum(sum(g[s]) ** 2 / (sum(h[s]) + strength) for s in (left, right)) - sum(g[rows]) ** 2 / (sum(h[rows]) + strength)
                key = (round(gain, 9), -f, -cut, missing_left)
                if gain > 0 and (best is None or key > best[0]):
                    best = (key, f, cut, missing_left, left, right)
    return best


def plain_boost(x, y, w, edges, rounds, leaves, least, strength, rate, classes):
    b = np.array([[0 if math.isnan(v) else 1 + sum(e < v for e in edges[j]) for j, v in enumerate(row)] for row in x])
    share = np.array([w[y == k].sum() for k in range(classes)]) / w.sum()
    raw = np.tile(np.log(share) if classes > 2 else np.log(share[1:] / share[0]), (len(y), 1))
    for _ in range(rounds):
        p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True) if classes > 2 else 1 / (1 + np.exp(-raw))
        step = np.zeros_like(raw)
        for k in range(raw.shape[1]):
            hit = (y == k) if classes > 2 else (y == 1)
            g, h = w * (p[:, k] - hit), w * p[:, k] * (1 - p[:, k])
            at = [list(range(len(y)))]
            while len(at) < leaves:
                options = [(plain_split(b, rows, g, h, strength, least), i) for i, rows in enumerate(at)]
                options = [(s, i) for s, i in options if s]
                if not options:
                    break
                s, i = max(options, key=lambda o: o[0][0][0])
                at[i : i + 1] = [s[4], s[5]]
            for rows in at:
                step[rows, k] = -rate * sum(g[rows]) / (sum(h[rows]) + strength)
        raw = raw + step
    return raw


@pytest.mark.parametrize("most", [63, 7])
def test_bins(spark, most):
    data, x, _, _ = table(spark)
    got = trees.thresholds(trees.bins(data, most), D)
    for a, b in zip(got, plain_bins(x, most), strict=True):
        assert np.allclose(a, b, atol=0)
    held = trees.to_bins(x, got)
    assert ((held == 0) == np.isnan(x)).all() and held.max() <= most


@pytest.mark.parametrize("most,cuts", [(63, 512), (63, 4), (7, 4), (7, 30)])
def test_bins_whatever_the_cuts(spark, monkeypatch, most, cuts):
    monkeypatch.setattr(trees, "CUTS", cuts)
    r = np.random.default_rng(3)
    n = 900
    rare = np.where(r.random(n) < 0.97, 1.0, r.integers(0, 40, n).astype(float))  # one value nearly everywhere
    x = np.stack([r.normal(size=n), rare, np.arange(n) % most, np.arange(n) % (most + 1), np.full(n, np.nan), np.exp(9 * r.normal(size=n)), np.full(n, 2.0)], 1)
    x[r.random(x.shape) < 0.1] = np.nan
    x[0, :2], x[1, 0], x[2, 2], x[3, 2] = [np.inf, -0.0], -np.inf, -0.0, 0.0
    rows = [(i, 0, [None if math.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    table = spark.createDataFrame([*rows, (n, 0, None), (n + 1, 0, []), (n + 2, 0, [5.0])], "subject long, y int, x array<double>").repartition(3)
    got = trees.bins(table, most).collect()
    x = np.vstack([x, [5.0, *[np.nan] * 6]])  # a short row lacks its last features
    want = plain_bins(np.where(x == 0, 0.0, x), most)
    for f, b in enumerate(want):
        mine = sorted((g for g in got if g["feature"] == f), key=lambda g: g["bin"])
        v = x[~np.isnan(x[:, f]), f]
        at = np.searchsorted(b, v, side="left")
        assert [g["threshold"] for g in mine[:-1]] == b.tolist() and [g["bin"] for g in mine] == sorted(set(at + 1))
        assert [(g["low"], g["high"], g["n"]) for g in mine] == [(v[at == i].min(), v[at == i].max(), (at == i).sum()) for i in sorted(set(at))]
    assert {g["feature"] for g in got} == {0, 1, 2, 3, 5, 6}
    assert trees.bins(table.limit(0), most).collect() == []


def shuffled_rows(spark, work):
    """Rows that stages wrote to shuffles while ``work`` ran."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    work()
    return sum(n for stage, n in total().items() if stage not in before)


def test_bins_shuffle_few_of_the_values(spark):
    data = spark.range(0, 60_000, numPartitions=2).select(F.col("id").alias("subject"), F.lit(0).alias("y"), F.array(*[F.xxhash64("id", F.lit(k)).cast("double") for k in range(4)]).alias("x"))
    out = []
    assert shuffled_rows(spark, lambda: out.extend(trees.bins(data).collect())) < 4 * 60_000
    assert len(out) == 4 * 63 and sum(r["n"] for r in out) == 4 * 60_000


@pytest.mark.parametrize("classes,leaves,rounds", [(3, 4, 2), (2, 6, 2)])
def test_boosting_equals_a_plain_build(spark, classes, leaves, rounds):
    data, x, y, w = table(spark, 120, classes=classes)
    model = trees.boost(data, D, rounds, classes, rate=0.3, leaves=leaves, least=8, strength=1.0, most_bins=7)
    want = plain_boost(x, y, w, plain_bins(x, 7), rounds, leaves, 8, 1.0, 0.3, classes)
    assert np.allclose(model.raw(x), want, atol=1e-9)
    assert all(len(t.feature) <= 2 * leaves - 1 for turn in model.trees for t in turn)


def test_scores_over_written_rounds_and_from_a_table(spark, tmp_path, monkeypatch):
    data, x, y, _ = table(spark)
    whole = trees.boost(data, D, 5, least=5)
    monkeypatch.setattr(trees, "WRITE_EVERY", 2)
    again = trees.boost(data, D, 5, least=5)
    assert np.allclose(whole.raw(x), again.raw(x), atol=1e-9)
    trees.model_table(spark, whole).write.parquet(str(tmp_path / "m"))
    back = trees.model_of(spark.read.parquet(str(tmp_path / "m")))
    assert (back.raw(x) == whole.raw(x)).all()
    with pytest.raises(ValueError, match="lacks nodes"):
        trees.model_of(spark.read.parquet(str(tmp_path / "m")).filter("not (turn = 1 and node = 0)"))
    got = {r.subject: (r.p0, r.p1, r.p2) for r in trees.scored(data, whole.proba).collect()}
    assert np.allclose([got[i] for i in range(len(x))], whole.proba(x))
    assert (whole.proba(x).argmax(1) == y).mean() > 0.6


def coalition_value(tree, x, inside, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    f, a, b = tree.feature[node], tree.left[node], tree.right[node]
    if f in inside:
        left = tree.missing_left[node] if math.isnan(x[f]) else x[f] <= tree.threshold[node]
        return coalition_value(tree, x, inside, a if left else b)
    return sum(tree.cover[c] / tree.cover[node] * coalition_value(tree, x, inside, c) for c in (a, b))


def test_contributions_equal_all_coalitions(spark):
    data, x, _, _ = table(spark, 200)
    model = trees.boost(data, D, 3, leaves=12, depth=4, least=4, strength=0.5, rate=0.5)
    assert any(len(set(p.features.tolist())) >= 3 for turn in model.trees for t in turn for p in trees.paths_of(t))
    got = {(r.subject, r.klass): r for r in trees.contributions(data.filter("subject < 12"), model).collect()}
    assert len(got) == 36
    for (subject, k), r in got.items():
        for f in range(D):
            want = 0.0
            others = [j for j in range(D) if j != f]
            for size in range(D):
                for s in itertools.combinations(others, size):
                    share = math.factorial(size) * math.factorial(D - size - 1) / math.factorial(D)
                    want += share * sum(coalition_value(turn[k], x[subject], {*s, f}) - coalition_value(turn[k], x[subject], {*s}) for turn in model.trees)
            assert abs(r.phi[f] - want) < 1e-10
        assert abs(sum(r.phi) + r.base - r.raw) < 1e-10


def test_contributions_that_do_not_add_up_are_refused(spark):
    data, _, _, _ = table(spark, 60)
    model = trees.boost(data, D, 1, least=4)
    node = model.trees[0][0]
    assert node.feature[0] >= 0
    leaf = int(np.flatnonzero(node.feature < 0)[0])
    node.cover[leaf] *= 1.5  # shares of rows are no longer those of the tree
    with pytest.raises(Exception, match="miss the score"):
        trees.contributions(data, model).collect()


def plain_extra(x, y, w, tree, seed, tried, least, depth, classes):
    """One tree by recursion with the same draws: a function of rows."""

    def grow(node, rows):
        shares = np.array([w[rows][y[rows] == k].sum() for k in range(classes)])
        if node == 1 or (len(rows) >= 2 * least and (shares > 0).sum() > 1 and node.bit_length() <= depth):
            order = trees.draw_features(seed, tree, node, x.shape[1])
            for turn in range(0, len(order), tried):
                best, varied = None, False
                for f in order[turn : turn + tried]:
                    low, high = x[rows, f].min(), x[rows, f].max()
                    if low == high:
                        continue
                    varied = True
                    t = trees.draw_threshold(seed, tree, node, int(f), low, high)
                    sides = [rows[x[rows, f] <= t], rows[x[rows, f] > t]]
                    if min(map(len, sides)) < least:
                        continue
                    gini = 0.0
                    for s in sides:
                        c = np.array([w[s][y[s] == k].sum() for k in range(classes)])
                        gini += c.sum() - (c**2).sum() / c.sum()
                    if best is None or round(gini, 9) < round(best[0], 9):
                        best = (gini, f, t, sides)
                if best:
                    _, f, t, sides = best
                    a, b = grow(2 * node, sides[0]), grow(2 * node + 1, sides[1])
                    return lambda v: a(v) if v[f] <= t else b(v)
                if varied:
                    break
        return lambda v: shares / shares.sum()

    return grow(1, np.arange(len(x)))


def test_extra_trees_equal_a_plain_build(spark):
    data, x, y, w = table(spark, 150, missing=0.0)
    x = np.nan_to_num(x, nan=9.0)
    data = data.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(9.0))))
    model = trees.extra_trees(data, D, 4, least=2, depth=5, tried=2, seed=3)
    plain = [plain_extra(x, y, w, t, 3, 2, 2, 5, 3) for t in range(4)]
    assert np.allclose(model.proba(x), [np.mean([p(row) for p in plain], 0) for row in x], atol=1e-12)
    assert (model.proba(x).argmax(1) == y).mean() > np.bincount(y).max() / len(y)


def test_extra_trees_try_on_past_constant_features(spark):
    rows = [(i, i % 2, [1.0, 1.0, 1.0, float(i % 2)]) for i in range(20)]
    data = spark.createDataFrame(rows, "subject long, y int, x array<double>")
    model = trees.extra_trees(data, 4, 5, classes=2, tried=1, seed=1)
    assert (model.proba(np.array([r[2] for r in rows])).argmax(1) == [r[1] for r in rows]).all()


def test_refusals(spark):
    data, _, _, _ = table(spark, 40)
    with pytest.raises(Exception, match="missing values"):
        trees.extra_trees(data, D, 1)
    with pytest.raises(Exception, match="no class"):
        trees.boost(data.withColumn("y", F.when(F.col("subject") > 3, F.col("y"))), D, 1)
    with pytest.raises(ValueError, match="classes"):
        trees.boost(data.filter("y <> 1"), D, 1)
    with pytest.raises(ValueError, match="classes"):
        trees.boost(data.limit(0), D, 1)
    with pytest.raises(Exception, match="unequal"):
        trees.boost(data.withColumn("x", F.expr("slice(x, 1, IF(subject = 3, 2, 5))")).coalesce(1), D, 1)


def test_out_of_fold_takes_such_models(spark):
    data, _, _, _ = table(spark, 90)
    folds = data.select("subject", (F.col("subject") % 3).cast("int").alias("fold"))
    out = learners.out_of_fold(lambda train: trees.boost(train, D, 1, least=4), data, folds, 3).collect()
    assert sorted(r.subject for r in out) == list(range(90)) and all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 and r.fold == r.subject % 3 for r in out)
