"""Nearest-neighbour information against the definition, pair by pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.functions.scalars import digamma
from diurna.operators import matrix


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(rows, k):
    """``rows``: (y, value)."""
    sizes = {c: sum(y == c for y, _ in rows) for c in {y for y, _ in rows}}
    rows = [(y, v) for y, v in rows if sizes[y] > 1]
    total = []
    for i, (y, v) in enumerate(rows):
        gaps = sorted(abs(v - w) for j, (z, w) in enumerate(rows) if z == y and j != i)
        need = min(k, sizes[y] - 1)
        r = gaps[need - 1]
        m = sum(abs(v - w) < r if r > 0 else v == w for _, w in rows)
        total.append(psi(need) - psi(sizes[y]) - psi(m))
    return max(0.0, psi(len(rows)) + sum(total) / len(total))


@pytest.mark.parametrize("block,k", [(4096, 3), (5, 3), (2, 1)])
def test_against_pairs(spark, monkeypatch, block, k):
    monkeypatch.setattr(matrix, "NEIGHBOUR_BLOCK", block)
    r = np.random.default_rng(3)
    table, want = [], {}
    for f in range(4):
        y = r.choice([0, 0, 0, 1, 1, 2], 90)
        y[0] = 9  # a class of one row
        v = [r.normal(size=90) + y, np.round(r.normal(size=90) + y, 1), r.integers(0, 3, 90).astype(float), np.full(90, 2.5)][f]
        table += [(i, int(y[i]), f, float(v[i])) for i in range(90)]
        want[f] = plain(list(zip(y.tolist(), v.tolist(), strict=True)), k)
    table.append((500, 0, 0, None))
    got = matrix.neighbour_information(spark.createDataFrame(table, "subject long, y int, feature int, value double"), k)
    assert all(abs(x["mi"] - want[x["feature"]]) < 1e-9 for x in got.collect()) and got.count() == 4
    assert want[0] > 0.1


def test_digamma(spark):
    got = spark.range(1, 300).select("id", digamma(F.col("id")).alias("v")).collect()
    assert all(math.isclose(x["v"], psi(x["id"]), abs_tol=1e-12) for x in got)
