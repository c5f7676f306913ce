"""Feature matrices in long form: ``subject, y, feature, value``.

Statistics come from the rows given, the training fold; transforms only apply
them, so a fold's figures can't leak into another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digamma
from .lineage import checkpointed
from .ranking import running_totals


def usable_features(long: DataFrame, share: float = 0.1, least: int = 2, round_up: bool = True) -> DataFrame:
    """Features with enough values and more than one of them."""
    subjects = long.select("subject").distinct().agg(F.count(F.lit(1)).alias("n"))
    need = F.ceil(F.col("n") * share) if round_up else F.floor(F.col("n") * share)
    agg = long.groupBy("feature").agg(F.count("value").alias("present"), F.count_distinct("value").alias("kinds"))
    agg = agg.join(F.broadcast(subjects))  # one row
    return agg.filter((F.col("present") >= F.greatest(F.lit(least), need)) & (F.col("kinds") > 1)).select("feature", "present", "kinds")


def fit_statistics(long: DataFrame) -> DataFrame:
    """Median for filling, then centre and scale of the filled values, by feature."""
    medians = long.groupBy("feature").agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("fill"))
    filled = fill(long, medians)
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = filled.groupBy("feature").agg(F.first("fill").alias("fill"), q.alias("q"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    spread = F.col("q")[2] - F.col("q")[0]
    return agg.select("feature", "fill", F.col("q")[1].alias("center"), F.when(spread == 0, 1.0).otherwise(spread).alias("scale"), "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std"))


def fill(long: DataFrame, statistics: DataFrame) -> DataFrame:
    """Missing values by the feature's median; needs ``feature, fill``."""
    return long.join(F.broadcast(statistics), "feature").withColumn("value", F.coalesce("value", "fill"))


def scale(long: DataFrame, statistics: DataFrame, kind: str = "robust", clip: float = 20.0) -> DataFrame:
    """Filled values scaled by ``robust`` or ``standard`` figures, clipped.

    A feature without statistics is an error: it wasn't there in training.
    """
    rows = long.join(F.broadcast(statistics), "feature", "left")
    known = F.when(F.col("fill").isNull(), F.raise_error(F.concat(F.lit("feature without statistics: "), F.col("feature").cast("string"))).cast("double")).otherwise(F.coalesce("value", "fill"))
    z = (known - F.col("center")) / F.col("scale") if kind == "robust" else (known - F.col("mean")) / F.col("std")
    return rows.select(*long.columns[:-1] if long.columns[-1] == "value" else [c for c in long.columns if c != "value"], F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("value"))


def anova(filled: DataFrame) -> DataFrame:
    """F statistic of each feature over the classes; ranked, ties by feature.

    Without spread inside classes F counts as 1e30, without any as lowest.
    """
    by = filled.groupBy("feature", "y").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = Window.partitionBy("feature")
    by = by.withColumn("g", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    d = F.col("m") - F.col("g")
    agg = by.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * d * d).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    f = (F.col("between") / (F.col("k") - 1)) / (F.nullif(F.col("within"), F.lit(0.0)) / (F.col("n") - F.col("k")))
    score = F.when((F.col("k") < 2) | (F.col("between") + F.col("within") == 0), F.lit(-1e300)).otherwise(F.coalesce(f, F.lit(1e30)))
    # one row for each feature
    return agg.select("feature", score.alias("f")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f"), "feature")))


def mutual_information(filled: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information of class and equal-width bins of a feature, in nats.

    A plain histogram estimate, not the nearest-neighbour one.
    """
    ends = filled.groupBy("feature").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))  # a row for each feature
    at = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * bins).cast("int"))
    cells = filled.join(ends, "feature").withColumn("b", F.coalesce(at, F.lit(0))).groupBy("feature", "y", "b").agg(F.count(F.lit(1)).alias("n"))
    # windows over at most classes times bins rows of a feature
    cells = cells.withColumns({"nb": F.sum("n").over(Window.partitionBy("feature", "b")), "ny": F.sum("n").over(Window.partitionBy("feature", "y")), "all": F.sum("n").over(Window.partitionBy("feature"))})
    return cells.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nb") * F.col("ny")))).alias("mi"))


#: Values of a class and feature that a task searches for neighbours at once.
NEIGHBOUR_BLOCK = 4096


def neighbour_information(filled: DataFrame, k: int = 3) -> DataFrame:
    """Mutual information of class and a feature by nearest neighbours: ``feature, mi``, in nats, 0 at least.

    A value's radius is the distance to its ``k``-th neighbour of the same
    class (its last one in a smaller class; classes of one row are left out).
    It is held against the number of values of any class that lie nearer, or
    are equal where the radius is 0.  Nulls are left out.

    Different values of a class are numbered in their order and searched in
    blocks of ``NEIGHBOUR_BLOCK``, each with the ``k`` values around it.  Values
    within a radius are the difference of two running counts.
    """
    cells = filled.filter(F.col("value").isNotNull()).groupBy("feature", "y", "value").agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("one"))
    sizes = cells.groupBy("feature", "y").agg(F.sum("n").alias("size")).filter("size > 1")
    kept = cells.join(sizes, ["feature", "y"])
    at = F.col("cum_one") - 1
    own = F.floor(at / NEIGHBOUR_BLOCK)
    ranked = running_totals(kept, ["feature", "y"], "value", ["one"])
    spread = ranked.withColumn("block", F.explode(F.sequence(F.floor((at - k) / NEIGHBOUR_BLOCK), F.floor((at + k) / NEIGHBOUR_BLOCK))))
    spread = spread.select("feature", "y", "block", "value", "n", "size", (F.col("block") == own).alias("own"))
    kind = filled.schema["feature"].dataType.simpleString()

    def nearer(v, r, way):
        """The first value on one side whose distance, as subtraction rounds it, is no longer below ``r``."""
        import numpy as np

        slack = 4 * np.spacing(np.maximum(np.abs(v), r))
        inside, outside = np.where(way > 0, np.maximum(v, v + r - slack), np.minimum(v, v - r + slack)), v + way * (r + slack)
        for _ in range(80):
            middle = (inside + outside) / 2
            near = np.abs(middle - v) < r
            inside, outside = np.where(near, middle, inside), np.where(near, outside, middle)
        return np.where(r > 0, outside, v)

    def radii(key, part):
        import numpy as np
        import pandas as pd

        part = part.sort_values("value", kind="stable")
        v, n, size = part["value"].to_numpy(), part["n"].to_numpy(), part["size"].to_numpy()
        near = np.arange(len(v))[:, None] + np.arange(-k, k + 1)
        there = (near >= 0) & (near < len(v))
        near = near.clip(0, len(v) - 1)
        gap = np.where(there, np.abs(v[near] - v[:, None]), np.inf)
        count = np.where(there, n[near] - (near == np.arange(len(v))[:, None]), 0)
        order = np.argsort(gap, 1, kind="stable")
        need = np.minimum(k, size - 1)
        last = (np.cumsum(np.take_along_axis(count, order, 1), 1) < need[:, None]).sum(1)
        r = np.take_along_axis(gap, order, 1)[np.arange(len(v)), np.minimum(last, 2 * k)]
        low, high = nearer(v, r, -1.0), nearer(v, r, 1.0)
        out = pd.DataFrame({"feature": part["feature"].to_numpy(), "n": n, "size": size, "k": need, "r": r, "low": low, "high": high})
        return out[part["own"].to_numpy()]

    rows = checkpointed(spread.groupBy("feature", "y", "block").applyInPandas(radii, f"feature {kind}, n long, size long, k long, r double, low double, high double"))
    places = kept.select("feature", F.col("value").alias("at"), "n")
    for bound in ("low", "high"):
        places = places.unionByName(rows.select("feature", F.col(bound).alias("at"), F.lit(0).cast("long").alias("n")))
    counted = checkpointed(running_totals(places.groupBy("feature", "at").agg(F.sum("n").alias("n")), ["feature"], "at", ["n"]))
    upto, below = F.col("cum_n"), F.col("cum_n") - F.col("n")
    lower = counted.select("feature", F.col("at").alias("low"), upto.alias("upto_low"), below.alias("below_low"))
    upper = counted.select("feature", F.col("at").alias("high"), upto.alias("upto_high"), below.alias("below_high"))
    inside = F.when(F.col("r") > 0, F.col("below_high") - F.col("upto_low")).otherwise(F.col("upto_high") - F.col("below_low"))
    held = rows.join(lower, ["feature", "low"]).join(upper, ["feature", "high"]).withColumn("m", inside)
    mean = lambda c: F.sum(F.col("n") * digamma(c)) / F.sum("n")
    raw = digamma(F.sum("n")) + mean(F.col("k")) - mean(F.col("size")) - mean(F.col("m"))
    return held.groupBy("feature").agg(F.greatest(F.lit(0.0), raw).alias("mi"))


def correlations(filled: DataFrame, features: list) -> DataFrame:
    """Pearson r of all pairs of a bounded list of features, a < b."""
    some = filled.filter(F.col("feature").isin(features)).select("subject", "feature", "value")
    # one row for each subject, a short vector; pairs are formed inside the row
    wide = some.groupBy("subject").pivot("feature", features).agg(F.first("value"))
    aggs = [F.corr(F.col(f"`{x}`"), F.col(f"`{y}`")).alias(f"{i}_{j}") for i, x in enumerate(features) for j, y in enumerate(features) if i < j]
    row = wide.agg(*aggs)
    pairs = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"{i}_{j}").alias("r")) for i, x in enumerate(features) for j, y in enumerate(features) if i < j]
    return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def correlation_filter(filled: DataFrame, ranked: list, limit: float, k: int) -> list:
    """The ``k`` best-ranked features of which no two correlate by ``limit`` or more.

    The best ``3 k``, and 500 at least, are looked at, as in the ranking they
    come from; their products are summed on the cluster, one matrix a task.
    """
    from .learners import vector_correlations, vectors

    pool = ranked[: max(500, 3 * k)]
    r: dict = {}
    for a, b, c in vector_correlations(vectors(filled, pool), list(range(len(pool)))).collect():
        r[a, b] = r[b, a] = abs(c or 0.0)
    chosen: list[int] = []
    for i in range(len(pool)):
        if len(chosen) < k and all(r[i, c] < limit for c in chosen):
            chosen.append(i)
    return [pool[i] for i in chosen]


def audit(long: DataFrame) -> DataFrame:
    """Subjects, features, missing share, constant features, repeated complete rows."""
    features = long.groupBy("feature").agg(F.count_distinct("value").alias("kinds"))
    rows = long.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("row"), F.count("value").alias("present"), F.count(F.lit(1)).alias("n"))
    twice = rows.filter("present = n").groupBy(F.sha2(F.to_json("row"), 256)).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("repeated_rows"))
    whole = long.agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("feature").alias("features"), (1 - F.count("value") / F.count(F.lit(1))).alias("missing_fraction"))
    constant = features.agg(F.count(F.when(F.col("kinds") <= 1, F.lit(1))).alias("constant_features"))
    # three tables of one row each
    return whole.join(F.broadcast(constant)).join(F.broadcast(twice))


def subject_weights(rows: DataFrame, balance: float) -> DataFrame:
    """Weights that give subjects equal say, then classes by count ** -balance; mean 1."""
    per = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("subject")))
    people = rows.select("subject", "y").distinct().groupBy("y").agg(F.count(F.lit(1)).alias("_c"))
    raw = per.join(F.broadcast(people), "y").withColumn("_w", (1 / F.col("_n")) * F.pow(F.col("_c").cast("double"), F.lit(-balance)))
    mean = raw.agg(F.avg("_w").alias("_mean"))
    return raw.join(F.broadcast(mean)).select("subject", "y", (F.col("_w") / F.col("_mean")).alias("weight"))


def gaussian_scores(filled: DataFrame, smoothing: float = 1e-3) -> DataFrame:
    """Naive Bayes with normal features: ``subject, p0, p1, p2``."""
    top = filled.groupBy("feature").agg(F.var_pop("value").alias("v")).agg((F.max("v") * smoothing).alias("eps"))
    stats = filled.groupBy("y", "feature").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v")).withColumnRenamed("y", "k")
    prior = filled.select("subject", "y").distinct().groupBy("y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    prior = prior.select(F.col("y").alias("k"), F.ln(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("prior"))
    stats = stats.join(F.broadcast(top)).withColumn("v", F.col("v") + F.col("eps"))
    d = F.col("value") - F.col("m")
    likely = -0.5 * (F.ln(2 * F.pi() * F.col("v")) + d * d / F.col("v"))
    by = filled.select("subject", "feature", "value").join(F.broadcast(stats), "feature").groupBy("subject", "k").agg(F.sum(likely).alias("l")).join(F.broadcast(prior), "k")
    best = by.groupBy("subject").agg(*[F.max(F.when(F.col("k") == k, F.col("l") + F.col("prior"))).alias(f"l{k}") for k in range(3)])
    peak = F.greatest("l0", "l1", "l2")
    e: list[Column] = [F.coalesce(F.exp(F.col(f"l{k}") - peak), F.lit(0.0)) for k in range(3)]
    return best.select("subject", *[(x / (e[0] + e[1] + e[2])).alias(f"p{k}") for k, x in enumerate(e)])


def keep_order(long: DataFrame, k: int | None = None) -> DataFrame:
    """The ``k`` best usable features by ANOVA, in the order of the columns: ``place, feature, rank, f``.

    Medians fill missing values for the ranking only; ties go to the earlier
    feature.  Without ``k`` all usable features stay.
    """
    some = long.join(F.broadcast(usable_features(long).select("feature")), "feature", "left_semi")
    medians = some.groupBy("feature").agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("fill"))
    ranked = anova(fill(some, medians))
    best = ranked if k is None else ranked.filter(F.col("rank") <= k)
    # one row for each feature
    return best.select((F.row_number().over(Window.orderBy("feature")) - 1).alias("place"), "feature", "rank", "f")


def missing_shares(long: DataFrame, best: int = 15) -> DataFrame:
    """The features with the largest share of missing values, ties by feature."""
    share = long.groupBy("feature").agg((1 - F.count("value") / F.count(F.lit(1))).alias("missing_fraction"), F.count("value").alias("present"))
    return share.orderBy(F.desc("missing_fraction"), "feature").limit(best)


def class_boxes(long: DataFrame) -> DataFrame:
    """Quartiles and whiskers of each feature in each class; missing values are left out.

    A whisker ends at the outermost value within 1.5 times the inter-quartile
    range of the box; ``n_outside`` counts those beyond.
    """
    rows = long.filter(F.col("value").isNotNull())
    q = rows.groupBy("feature", "y").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select("feature", "y", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.join(q, ["feature", "y"]).groupBy("feature", "y", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("low"),
        F.max(F.when(inside, F.col("value"))).alias("high"),
        F.count(F.when(~inside, F.lit(1))).alias("n_outside"),
    )
