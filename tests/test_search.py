from itertools import permutations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from diurna.operators import learners, matrix, policy


def vectors(spark, x, y=None):
    rows = [(i, int(y[i]) if y is not None else 0, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "subject long, y int, x array<double>").select("subject", "y", array_to_vector("x").alias("features"))


def exact(score, x, background):
    """Mean gain of each feature over all orders."""
    d = len(x)
    phi = np.zeros((d, score(background).shape[1]))
    orders = list(permutations(range(d)))
    for order in orders:
        mixed, last = background.copy(), score(background).mean(0)
        for f in order:
            mixed[:, f] = x[f]
            now = score(mixed).mean(0)
            phi[f] += now - last
            last = now
    return phi / len(orders)


def test_shapley_values(spark):
    rng = np.random.default_rng(4)
    x, base = rng.normal(size=(6, 4)), rng.normal(size=(7, 4))
    w = rng.normal(size=(4, 3))

    def curved(a):
        z = np.exp(a @ w)
        return z / z.sum(1, keepdims=True)

    for score, rounds, near in ((lambda a: a @ w, 1, 1e-9), (curved, 60, 0.02)):
        got = {(r["subject"], r["feature"], r["klass"]): r["contribution"] for r in learners.shapley_values(vectors(spark, x), score, base, 1, rounds).collect()}
        assert len(got) == 6 * 4 * 3
        for s in range(6):
            phi = np.array([[got[s, f, k] for k in range(3)] for f in range(4)])
            assert np.allclose(phi, exact(score, x[s], base), atol=near)
            assert np.allclose(phi.sum(0), score(x[s : s + 1])[0] - score(base).mean(0))
    assert learners.background_rows(vectors(spark, x), 1, 4).shape == (4, 4)


def test_shapley_values_of_linear_scores(spark):
    """Running sums give what scoring each step does, and the link sees all steps of an order at once."""
    rng = np.random.default_rng(8)
    x, base, w, c = rng.normal(size=(5, 6)), rng.normal(size=(9, 6)), rng.normal(size=(3, 6)), rng.normal(size=3)

    def link(z, axis):
        if z.ndim == 2 and z.shape != (9, 3):
            raise ValueError("a step scored by itself")
        e = np.exp(z)
        return e / e.sum(axis, keepdims=True)

    plain = lambda a: np.exp(a @ w.T + c) / np.exp(a @ w.T + c).sum(1, keepdims=True)
    key = lambda r: (r["subject"], r["feature"], r["klass"])
    got, want = ({key(r): r["contribution"] for r in learners.shapley_values(vectors(spark, x), s, base, 2, 2).collect()} for s in (learners.LinearScore(w, c, link), plain))
    assert len(got) == 5 * 6 * 3 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_parameter_search_goes_on(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = np.arange(60) % 3
    data = vectors(spark, rng.normal(size=(60, 3)) + 2 * np.eye(3)[y], y)
    folds = data.select("subject", (F.col("subject") % 2).cast("int").alias("fold"))

    def broken(**values):
        raise ValueError("no such tree")

    monkeypatch.setitem(learners.FAMILIES, "forest", broken)
    first = learners.parameter_search(data, folds, 2, ["logistic", "forest"], 1, 3)
    rows = {r["family"]: r for r in first.collect()}
    assert rows["logistic"]["status"] == "done" and rows["logistic"]["macro_recall"] > 0.6 and rows["logistic"]["log_loss"] < 1.2
    assert rows["forest"]["status"] == "failed" and "no such tree" in rows["forest"]["error"] and rows["forest"]["macro_recall"] is None
    again = learners.parameter_search(data, folds, 2, ["logistic", "forest"], 2, 3, done=first)
    assert [(r["family"], r["trial"]) for r in again.orderBy("family", "trial").collect()] == [("forest", 0), ("forest", 1), ("logistic", 0), ("logistic", 1)]
    for t in range(20):
        v = learners.drawn_parameters("forest", t, 1)
        assert 5 <= v["trees"] <= 40 and 2 <= v["depth"] <= 8


def test_random_votes(spark):
    votes = spark.range(1).select(F.explode(policy.random_votes(400, 6, 9)).alias("v")).select("v.*").collect()
    w = np.array([[v[f"m{m}"] for m in range(6)] for v in votes])
    size = (w > 0).any(2).sum(1)
    assert set(size) == {2, 3, 4, 5} and ((w > 0).all(2) == (w > 0).any(2)).all()
    for v, x in zip(votes, w, strict=True):
        assert v["by_class"] == (v["i"] % 2 == 1) and v["by_class"] != bool((x[:, 0] == x[:, 1]).all())
    share = (w[size == 2] / w[size == 2].sum(1, keepdims=True))[:, :, 0]
    assert abs(share[share > 0].mean() - 0.5) < 0.01 and share[share > 0].std() == pytest.approx(0.289, abs=0.05)  # even on (0, 1)


def test_keep_order_and_boxes(spark):
    rows = []
    for s in range(40):
        y = s % 2
        for f, v in enumerate([float(s % 7), float(y), None if s else 1.0, 3.0, y + (s % 5) / 10.0]):
            rows.append((s, y, f, v))
    long = spark.createDataFrame(rows, "subject int, y int, feature int, value double")
    got = [(r["place"], r["feature"], r["rank"]) for r in matrix.keep_order(long, 2).orderBy("place").collect()]
    assert got == [(0, 1, 1), (1, 4, 2)]  # features 2 and 3 aren't usable
    assert [r["feature"] for r in matrix.keep_order(long).orderBy("place").collect()] == [0, 1, 4]
    assert [(r["feature"], r["present"]) for r in matrix.missing_shares(long, 2).collect()] == [(2, 1), (0, 40)]
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    box = matrix.class_boxes(spark.createDataFrame([(0, 0, 0, v) for v in values], "subject int, y int, feature int, value double")).first()
    assert (box["q1"], box["median"], box["q3"], box["low"], box["high"], box["n"], box["n_outside"]) == (2.0, 3.0, 4.0, 1.0, 4.0, 5, 1)


def test_shapley_query_adds_up(spark):
    from diurna.plans import search_queries as q

    sf = "/root/testdata/sf0.001"
    data = q._vectors(spark, sf)
    w, c = learners.discriminant_weights(data)
    z = {r["subject"]: w @ np.array(r["features"].toArray()) + c for r in data.collect()}
    z = {s: v - v.max() - np.log(np.exp(v - v.max()).sum()) for s, v in z.items()}
    sums = q.shapley_values(spark, sf).groupBy("subject", "klass").agg(F.sum("contribution").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sums) == 3 * len(z) and {r["n"] for r in sums} == {64}
    for k in range(3):
        base = [z[r["subject"]][k] - r["s"] for r in sums if r["klass"] == k]
        assert np.ptp(base) < 1e-3  # the background's mean score, whoever is explained
