"""Kernel ridge regression through landmarks: exact where every row is one.

Landmarks are training rows, chosen by a hash of the subject, ``most`` at most.
Through the inverse square root of their own kernel a row becomes a vector whose
products are those of the kernel between landmarks.  Where there are no more
training rows than landmarks, that is the kernel itself, and the solution the
exact one; beyond, ``residual`` tells how much of the rows the landmarks miss.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import hash_int
from .trees import _parts, matrix_of, rows_of

#: Landmarks at most: the driver solves a system of so many unknowns.
LANDMARKS = 1024


def rbf(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - z|^2) of all rows of two matrices."""
    d = (x**2).sum(1)[:, None] + (z**2).sum(1)[None] - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(d, 0))


@dataclass
class Lift:
    """Rows as vectors whose products are the kernel's between landmarks."""

    landmarks: np.ndarray
    turn: np.ndarray
    gamma: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.landmarks, self.gamma) @ self.turn


def landmark_lift(data: DataFrame, gamma: float, most: int = LANDMARKS, seed: int = 7) -> Lift:
    """Landmarks of a table ``subject, x``: the first ``most`` different rows by hash.  Missing values are an error."""
    rows = data.select(hash_int(F.lit(seed), F.col("subject")).alias("h"), "subject", F.col("x").cast("array<double>").alias("x")).orderBy("h", "subject").limit(most)
    found = [r["x"] for r in rows.collect()]
    if not found:
        raise ValueError("no rows to take landmarks from")
    z = np.unique(np.array([[np.nan if v is None else v for v in x] for x in found], float), axis=0)
    if np.isnan(z).any():
        raise ValueError("missing values: fill them before a kernel")
    values, vectors = np.linalg.eigh(rbf(z, z, gamma))
    held = values > values[-1] * 1e-13  # copies and near copies add nothing
    return Lift(z, vectors[:, held] / np.sqrt(values[held]), gamma)


@dataclass
class Ridge:
    """Scores of classes: softmax of three times the regression on one-hot classes."""

    lift: Lift
    weights: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def proba(self, x: np.ndarray) -> np.ndarray:
        z = 3 * self.raw(x)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _sums(data: DataFrame, width: int, of) -> np.ndarray:
    """The sum over all rows of ``of(x, y, weight)``, ``width`` numbers: one row a task and number, added up on the cluster."""

    def run(batches):
        total = np.zeros(width)
        for part in _parts(batches, 1024):
            x = matrix_of(part.column("x"))
            if len(x):
                total += of(x, part.column("y").to_numpy(), part.column("weight").to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["i", "v"])

    out = np.zeros(width)
    for batch in data.select("x", "y", "weight").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().itertuples():
        out[batch.i] = batch.v
    return out


def ridge(data: DataFrame, gamma: float = 0.01, strength: float = 1.0, classes: int = 3, most: int = LANDMARKS, seed: int = 7) -> Ridge:
    """Kernel ridge on one-hot classes of ``subject, y, [weight,] x``: one pass over the rows.

    Products of lifted rows are added up in tasks; what reaches the driver is
    the square of the number of landmarks, whatever the number of rows.
    """
    lift = landmark_lift(data, gamma, most, seed)
    r = lift.turn.shape[1]

    def products(x, y, weight):
        z = lift(x)
        return np.concatenate([(z.T @ (z * weight[:, None])).ravel(), (z.T @ (np.eye(classes)[y] * weight[:, None])).ravel()])

    sums = _sums(rows_of(data), r * r + r * classes, products)
    return Ridge(lift, np.linalg.solve(sums[: r * r].reshape(r, r) + strength * np.eye(r), sums[r * r :].reshape(r, classes)))


def residual(data: DataFrame, lift: Lift) -> float:
    """Mean share of a row, by the kernel, that its landmarks miss: 0 where each row is one, 1 at most."""
    n, missed = _sums(rows_of(data), 2, lambda x, y, weight: np.array([len(x), (1 - (lift(x) ** 2).sum(1)).clip(0).sum()]))
    return float(missed / n)


# ---- margin machines -------------------------------------------------------


@dataclass
class Machine:
    """Margin machines of all pairs of classes over one lift; ``weights`` has a row for each pair, its constant last."""

    lift: Lift
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    classes: int

    def decisions(self, x: np.ndarray) -> np.ndarray:
        """A number for each pair: above 0 for its first class."""
        z = self.lift(x)
        return z @ self.weights[:, :-1].T + self.weights[:, -1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """A number for each class: pairs won, and by how much, squeezed between them; with two classes, that of the second."""
        d = self.decisions(x)
        if self.classes == 2:
            return -d
        votes, trust = np.zeros((len(x), self.classes)), np.zeros((len(x), self.classes))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += d[:, k] >= 0
            votes[:, b] += d[:, k] < 0
            trust[:, a] += d[:, k]
            trust[:, b] -= d[:, k]
        return votes + trust / (3 * (np.abs(trust) + 1))

    def proba(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        s = np.hstack([np.zeros_like(s), s]) if self.classes == 2 else s
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _bend(t: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hinge at margins ``t``, rounded within ``width`` of 1: value, slope, curvature."""
    inside = np.abs(1 - t) <= width
    short = np.where(inside, 1 + width - t, 0.0)
    value = np.where(inside, short**2 / (4 * width), np.maximum(1 - t, 0))
    return value, np.where(inside, -short / (2 * width), -(t < 1).astype(float)), inside / (2 * width)


def machine(data: DataFrame, gamma: float = 0.01, cost: float = 1.0, classes: int = 3, most: int = LANDMARKS, seed: int = 7, widths: tuple[float, ...] = (1.0, 0.4, 0.16, 0.06, 0.025, 0.01), steps: int = 25) -> Machine:
    """Margin machines with an RBF kernel, one for each pair of classes: hinge loss, constants free of the penalty.

    The hinge is rounded within a width that shrinks; each stage goes on from
    the last by Newton steps, whose sums are made by one pass over the rows for
    all pairs, with another pass that tries step lengths.  What reaches the
    driver is the square of the number of landmarks for each pair.  The
    solution differs from that of the sharp hinge by about the last width.  The
    constant, which has no penalty, is damped in steps only.
    """
    lift = landmark_lift(data, gamma, most, seed)
    rows = rows_of(data)
    r = lift.turn.shape[1] + 1
    pairs = [(a, b) for a in range(classes) for b in range(a + 1, classes)]
    v = np.zeros((len(pairs), r))
    penalty = np.ones(r)
    penalty[-1] = 0.0
    lengths = 0.5 ** np.arange(12)

    def sides(x, y, weight):
        z = np.hstack([lift(x), np.ones((len(x), 1))])
        for k, (a, b) in enumerate(pairs):
            own = (y == a) | (y == b)
            yield k, z[own] * np.where(y[own] == a, 1.0, -1.0)[:, None], cost * weight[own]

    for width in widths:
        for _ in range(steps):
            now = v

            def newton(x, y, weight, now=now, width=width):
                out = []
                for k, z, c in sides(x, y, weight):
                    _, slope, curve = _bend(z @ now[k], width)
                    out += [z.T @ (c * slope), (z.T @ (z * (c * curve)[:, None])).ravel()]
                return np.concatenate(out)

            sums = _sums(rows, len(pairs) * (r + r * r), newton).reshape(len(pairs), r + r * r)
            slope = sums[:, :r] + penalty * v
            if np.abs(slope).max() <= 1e-9 * (1 + cost):
                break
            turn = np.stack([np.linalg.solve(s[r:].reshape(r, r) + np.diag(np.where(penalty > 0, 1.0, 1e-2)), -g) for s, g in zip(sums, slope, strict=True)])

            def tried(x, y, weight, now=now, turn=turn, width=width):
                out = []
                for k, z, c in sides(x, y, weight):
                    t, d = z @ now[k], z @ turn[k]
                    out += [(c * _bend(t + s * d, width)[0]).sum() for s in (0.0, *lengths)]
                return np.array(out)

            loss = _sums(rows, len(pairs) * (1 + len(lengths)), tried).reshape(len(pairs), -1)
            moved = False
            for k in range(len(pairs)):
                whole = loss[k] + [0.5 * (penalty * (v[k] + s * turn[k]) ** 2).sum() for s in (0.0, *lengths)]
                best = int(np.argmin(whole))
                if best and whole[best] < whole[0]:
                    v = v.copy()
                    v[k] += lengths[best - 1] * turn[k]
                    moved = True
            if not moved:
                break
    return Machine(lift, pairs, v, classes)
