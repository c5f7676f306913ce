import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import kernels, trees
from test_trees import D, table


def test_against_an_exact_solve(spark):
    data, x, y, w = table(spark, 200, missing=0.0)
    x = np.nan_to_num(x, nan=0.5)
    data = data.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.5))))
    root = np.sqrt(w)
    for gamma, strength in ((0.1, 1.0), (1.0, 0.05)):
        k = kernels.rbf(x, x, gamma)
        dual = root[:, None] * np.linalg.solve(root[:, None] * k * root + strength * np.eye(200), root[:, None] * np.eye(3)[y])
        model = kernels.ridge(data, gamma, strength)
        assert np.abs(model.raw(x) - k @ dual).max() < 1e-6
        assert kernels.residual(data, model.lift) < 1e-9
        few = kernels.ridge(data, gamma, strength, most=40)
        missed = kernels.residual(data, few.lift)
        assert len(few.lift.landmarks) == 40 and 1e-6 < missed < 1
        assert np.abs(few.raw(x) - k @ dual).max() < 20 * np.sqrt(missed)
    said = {r.subject: (r.p0, r.p1, r.p2) for r in trees.scored(data, model.proba).collect()}
    assert np.allclose([said[i] for i in range(200)], model.proba(x)) and (model.proba(x).argmax(1) == y).mean() > 0.7


def test_copies_and_refusals(spark):
    data, _, _, _ = table(spark, 30)
    with pytest.raises(ValueError, match="missing"):
        kernels.ridge(data)
    with pytest.raises(ValueError, match="no rows"):
        kernels.ridge(data.limit(0))
    same = spark.createDataFrame([(i, i % 3, [1.0] * D) for i in range(9)], "subject long, y int, x array<double>")
    assert np.allclose(kernels.ridge(same).proba(np.ones((1, D))), 1 / 3)


def exact_machine(k, sign, cost):
    """The dual of the sharp hinge with a constant: pairs of weights moved, the worst first, until none is wrong."""
    n = len(sign)
    a, g = np.zeros(n), -np.ones(n)  # gradient of 1/2 a'Qa - sum a
    q = sign[:, None] * k * sign
    for _ in range(200_000):
        score = -sign * g
        up = ((sign > 0) & (a < cost - 1e-14)) | ((sign < 0) & (a > 1e-14))
        low = ((sign < 0) & (a < cost - 1e-14)) | ((sign > 0) & (a > 1e-14))
        i, j = np.where(up, score, -np.inf).argmax(), np.where(low, score, np.inf).argmin()
        if score[i] - score[j] < 1e-10:
            break
        step = (score[i] - score[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, cost[i] - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else cost[j] - a[j])
        a[i] += sign[i] * step
        a[j] -= sign[j] * step
        g += q[:, i] * sign[i] * step - q[:, j] * sign[j] * step
    return k @ (a * sign) + (score[i] + score[j]) / 2


def test_machine_against_the_exact_dual(spark):
    data, x, y, w = table(spark, 90, missing=0.0)
    x = np.nan_to_num(x, nan=0.5)
    data = data.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.5)))).coalesce(1).cache()
    model = kernels.machine(data, 0.2, 1.0, widths=tuple(0.4**i for i in range(16)), steps=40)
    got = model.decisions(x)
    for p, (a, b) in enumerate(model.pairs):
        own = (y == a) | (y == b)
        want = exact_machine(kernels.rbf(x[own], x[own], 0.2), np.where(y[own] == a, 1.0, -1.0), w[own])
        assert np.abs(got[own, p] - want).max() < 1e-3, (a, b)  # the hinge is rounded, and the last steps stall
    p = model.proba(x)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > np.bincount(y).max() / len(y)
    data.unpersist()
