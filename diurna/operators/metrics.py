"""Evaluation of three-class scores: ``id, y, p0, p1, p2``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running_totals

CLASSES = (0, 1, 2)


def confusion(df: DataFrame, y: str = "y", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Counts of true and predicted classes; one row for each group."""
    return df.groupBy(*by).agg(*[F.count(F.when((F.col(y) == a) & (F.col(predicted) == b), F.lit(1))).alias(f"n{a}{b}") for a in CLASSES for b in CLASSES])


def _parts(k: int) -> tuple[Column, Column, Column]:
    hit = F.col(f"n{k}{k}")
    return hit, sum((F.col(f"n{k}{j}") for j in CLASSES[1:]), F.col(f"n{k}0")), sum((F.col(f"n{i}{k}") for i in CLASSES[1:]), F.col(f"n0{k}"))


def report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; macro means; accuracy.

    A class without cases or predictions scores 0, as a ratio by zero does.
    """
    out, macro = {}, {"precision": [], "recall": [], "f1": []}
    for k in CLASSES:
        hit, actual, said = _parts(k)
        values = {"precision": _zero(hit, said), "recall": _zero(hit, actual), "f1": _zero(2 * hit, said + actual)}
        for name, v in values.items():
            out[f"{name}_{k}"] = v
            macro[name].append(v)
        out[f"support_{k}"] = actual
    for name, vs in macro.items():
        out[f"macro_{name}"] = (vs[0] + vs[1] + vs[2]) / 3
    every = sum((F.col(f"n{a}{b}") for a in CLASSES for b in CLASSES), F.lit(0))
    out["accuracy"] = _zero(sum((F.col(f"n{k}{k}") for k in CLASSES), F.lit(0)), every)
    return counts.withColumns(out)


def weighted_means(figures: DataFrame) -> DataFrame:
    """Add means of precision, recall and F1 weighted by support to a report."""
    every = sum((F.col(f"support_{k}") for k in CLASSES[1:]), F.col("support_0"))
    out = {}
    for name in ("precision", "recall", "f1"):
        total = sum((F.col(f"support_{k}") * F.col(f"{name}_{k}") for k in CLASSES[1:]), F.col("support_0") * F.col(f"{name}_0"))
        out[f"weighted_{name}"] = _zero(total, every)
    return figures.withColumns(out)


def _zero(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def one_vs_rest(df: DataFrame, y: str = "y") -> DataFrame:
    """One row for each case and class: ``class, score, hit``."""
    parts = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"p{k}").alias("score"), (F.col(y) == k).cast("long").alias("hit")) for k in CLASSES])
    return df.select(F.explode(parts).alias("x")).select("x.*")


def curve(rows: DataFrame, by: str = "class") -> DataFrame:
    """ROC and precision-recall points, a row for each distinct score, descending."""
    at = rows.groupBy(by, "score").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))
    total = rows.groupBy(by).agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    run = running_totals(at, [by], "score", ["hits", "misses"], descending=True).join(F.broadcast(total), by)
    return run.select(
        by, "score", "hits", "misses", "pos", "neg",
        F.col("cum_hits").alias("tp"),
        F.col("cum_misses").alias("fp"),
        (F.col("cum_hits") / F.nullif(F.col("pos").cast("double"), F.lit(0.0))).alias("tpr"),
        (F.col("cum_misses") / F.nullif(F.col("neg").cast("double"), F.lit(0.0))).alias("fpr"),
        (F.col("cum_hits") / (F.col("cum_hits") + F.col("cum_misses"))).alias("precision"),
    )


def areas(points: DataFrame, by: str = "class") -> DataFrame:
    """AUC (ties count half), average precision, best balanced recall of each class."""
    above = F.col("fp") - F.col("misses")  # misses with a higher score
    below = F.col("neg") - F.col("fp")
    return points.groupBy(by).agg(
        (F.sum(F.col("hits") * (below + F.col("misses") / 2)) / F.nullif(F.max("pos") * F.max("neg").cast("double"), F.lit(0.0))).alias("auc"),
        F.sum(F.col("hits") * F.col("precision") / F.nullif(F.col("pos").cast("double"), F.lit(0.0))).alias("average_precision"),
        F.greatest(F.lit(0.5), F.max((F.col("tpr") + 1 - F.col("fpr")) / 2)).alias("best_balanced_recall"),
        F.max(above).alias("misses_above_last"),
    )


def log_loss(df: DataFrame, y: str = "y", least: float = 1e-15) -> Column:
    """Mean negative log of the true class's score, clipped and renormalised."""
    p = [F.least(F.greatest(F.col(f"p{k}"), F.lit(least)), F.lit(1 - least)) for k in CLASSES]
    own = F.when(F.col(y) == 0, p[0]).when(F.col(y) == 1, p[1]).otherwise(p[2])
    return -F.avg(F.ln(own / (p[0] + p[1] + p[2])))
