"""Tables of experiment records: deltas, pools, consensus, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import guarded_corr


def parent_deltas(records: DataFrame, name: str, parent: str, figures: Sequence[str]) -> DataFrame:
    """Each record's figures less its parent's; null without one."""
    own, up = records.alias("r"), records.select(F.col(name).alias("_name"), *[F.col(f).alias(f"_{f}") for f in figures]).alias("p")
    out = own.join(up, F.col(f"r.{parent}") == F.col("p._name"), "left")
    return out.select("r.*", *[(F.col(f"r.{f}") - F.col(f"p._{f}")).alias(f"delta_{f}") for f in figures])


def reference_deltas(records: DataFrame, name: str, reference, figures: Sequence[str]) -> DataFrame:
    """Each record's figures less those of one reference record."""
    one = records.filter(F.col(name) == reference).agg(*[F.first(f).alias(f"_{f}") for f in figures])
    return records.join(F.broadcast(one)).select(*records.columns, *[(F.col(f) - F.col(f"_{f}")).alias(f"delta_{f}") for f in figures])


def best_per(records: DataFrame, signature: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first record of each signature in ``order``."""
    w = Window.partitionBy(*signature).orderBy(*order)
    return records.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def ordered_distinct(rows: DataFrame, value: str, place: str) -> DataFrame:
    """Distinct values by their first place."""
    return rows.groupBy(value).agg(F.min(place).alias(place))


def consensus(branches: DataFrame, branch: str, feature: str, value: str, weight: str) -> DataFrame:
    """Weighted sum of each branch's importances, normalised to sum 1 in a branch.

    A feature that a branch lacks counts 0 there.
    """
    w = Window.partitionBy(branch)
    share = F.abs(value) / F.nullif(F.sum(F.abs(value)).over(w), F.lit(0.0))
    rows = branches.select(feature, branch, (F.col(weight) * F.coalesce(share, F.lit(0.0))).alias("part"))
    return rows.groupBy(feature).agg(F.sum("part").alias("consensus"), F.count_distinct(branch).alias("branches"))


def fold_stability(importances: DataFrame, feature: str, fold: str, value: str, folds: int, least: float = 1e-10) -> DataFrame:
    """Mean and spread over folds, and the share of folds with any importance."""
    by = importances.groupBy(feature, fold).agg(F.avg(F.abs(value)).alias("v"))
    return by.groupBy(feature).agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), (F.count(F.when(F.col("v") > least, F.lit(1))) / F.lit(folds)).alias("nonzero_folds")
    )


def grouped_importance(importances: DataFrame, meta: DataFrame, feature: str, value: str, groups: Sequence[str]) -> DataFrame:
    """Sum, mean and number of importances by metadata; features without it under null."""
    return importances.join(F.broadcast(meta), feature, "left").groupBy(*groups).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def direction(values: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Sign of the guarded correlation of two columns; null where there is none."""
    return values.groupBy(*keys).agg(F.signum(guarded_corr(F.col(x), F.col(y), least)).alias("direction"))


def agreement(a: DataFrame, b: DataFrame, key: str, scores: Sequence[str], predicted: str) -> DataFrame:
    """Largest score difference and share of equal decisions of two result tables."""
    joined = a.alias("a").join(b.alias("b"), key)
    gap = F.greatest(*[F.abs(F.col(f"a.{s}") - F.col(f"b.{s}")) for s in scores]) if len(scores) > 1 else F.abs(F.col(f"a.{scores[0]}") - F.col(f"b.{scores[0]}"))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_abs_diff"), F.avg((F.col(f"a.{predicted}") == F.col(f"b.{predicted}")).cast("double")).alias("match_rate"))


def reconcile_labels(tables: Sequence[DataFrame], allowed: Sequence[str]) -> DataFrame:
    """``subject, label`` from several label tables; conflicts and unknown labels are errors."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    rows = rows.select("subject", F.upper(F.trim("label")).alias("label"))
    known = F.when(F.col("label").isin(*allowed), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null")))))
    agg = rows.select("subject", known.alias("label")).groupBy("subject").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    return agg.select("subject", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("conflicting labels of "), F.col("subject").cast("string")))).alias("label"))


def near_equal(scores: DataFrame, model: str, key: str, value: str, tolerance: float = 1e-8, relative: float = 0.0) -> DataFrame:
    """Pairs of models that have the same cases and nearly the same scores: ``a, b``, a < b.

    Scores are near where they differ by no more than ``tolerance`` and
    ``relative`` times the size of the one of ``a``.  Models of unlike cases
    differ, as do two scores of which one is null.  A case with two rows of one
    model is an error.

    A case's models stand in one row, so a pair needs no join of cases; each
    task counts the cases in which a pair is near, and a pair is one whose
    count is that of either model's cases.
    """
    wide = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(value).alias("v")))).alias("all"))
    own = wide.select(F.col("all.m").alias("m"), F.col("all.v").alias("v"))

    def same(batches):
        import numpy as np
        import pandas as pd

        place: dict = {}
        near = np.zeros((8, 8), np.int64)
        for part in batches:
            for m, v in zip(part["m"], part["v"], strict=True):
                at = np.array([place.setdefault(x, len(place)) for x in m])
                if len(np.unique(at)) < len(at):
                    raise ValueError("a case has two rows of one model")
                if len(place) > len(near):
                    more = np.zeros((2 * len(place), 2 * len(place)), np.int64)
                    more[: len(near), : len(near)] = near
                    near = more
                v = np.array([np.nan if x is None else x for x in v], float)
                for i in range(len(v)):  # one row of the matrix at a time; models stand in order, so the pair's first is i
                    near[at[i], at[i]] += 1  # the diagonal counts cases
                    near[at[i], at[i + 1 :]] += np.abs(v[i] - v[i + 1 :]) <= tolerance + relative * abs(v[i])
        names = list(place)
        i, j = np.nonzero(near[: len(names), : len(names)])
        yield pd.DataFrame({"a": [names[x] for x in i], "b": [names[x] for x in j], "n": near[i, j]})

    kind = scores.schema[model].dataType.simpleString()
    found = own.mapInPandas(same, f"a {kind}, b {kind}, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    cases = found.filter("a = b")
    left, right = cases.select("a", F.col("n").alias("_a")), cases.select("b", F.col("n").alias("_b"))
    return found.filter("a < b").join(left, "a").join(right, "b").filter("n = _a and n = _b").select("a", "b")


def distinct_predictions(scores: DataFrame, model: str, key: str, value: str, order: DataFrame, tolerance: float = 1e-8, relative: float = 0.0) -> list:
    """Models in ``order`` (a row for each) whose scores differ from every one kept before."""
    names = [r[0] for r in order.collect()]
    alike: dict = {}
    for a, b in near_equal(scores, model, key, value, tolerance, relative).collect():  # none but repeated models
        alike.setdefault(a, set()).add(b)
        alike.setdefault(b, set()).add(a)
    kept: list = []
    for n in names:
        if not alike.get(n, set()) & set(kept):
            kept.append(n)
    return kept
