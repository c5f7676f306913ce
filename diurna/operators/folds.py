"""Subject-disjoint folds and stratified resampling, by hash: no random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .ranking import hash_rank

#: Ranks of a page of predictions.
PAGE = 4096


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hash_int(*parts: Column) -> Column:
    """48 bits of a digest as a number."""
    return F.conv(F.substring(digest(*parts), 1, 12), 16, 10).cast("long")


def stratified_folds(subjects: DataFrame, k: int, seed: int) -> DataFrame:
    """``subject, y, fold``: each class dealt over the folds in hash order."""
    rows = subjects.select("subject", "y").distinct().withColumn("_d", digest(F.lit(seed), F.col("subject")))
    return hash_rank(rows, ["y"], "_d").select("subject", "y", ((F.col("rank") - 1) % k).cast("int").alias("fold"))


def nested_folds(subjects: DataFrame, outer: int, inner: int, seed: int) -> DataFrame:
    """Folds, and within each outer training set folds of its own.

    Returns ``subject, y, outer, inner``; the row of a subject in the outer
    fold that tests it has no inner fold.
    """
    first = stratified_folds(subjects, outer, seed)
    rows = first.select("subject", "y", F.col("fold").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("outer"))
    train = rows.filter("own <> outer").withColumn("_d", digest(F.lit(seed + 1), F.col("outer"), F.col("subject")))
    ranked = hash_rank(train, ["outer", "y"], "_d").select("subject", "y", "outer", ((F.col("rank") - 1) % inner).cast("int").alias("inner"))
    return ranked.unionByName(rows.filter("own = outer").select("subject", "y", "outer", F.lit(None).cast("int").alias("inner")))


def group_folds(subjects: DataFrame, k: int, seed: int) -> DataFrame:
    """Folds by hash of the subject alone: any row's fold is known without others."""
    return subjects.select("subject", "y").distinct().withColumn("fold", (hash_int(F.lit(seed), F.col("subject")) % k).cast("int"))


def composition(folds: DataFrame, k: int) -> DataFrame:
    """Training and test subjects of each fold, by class."""
    rows = folds.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    test = F.col("f") == F.col("fold")
    return rows.groupBy(F.col("f").alias("fold")).agg(
        F.count(F.when(~test, 1)).alias("train_subjects"),
        F.count(F.when(test, 1)).alias("test_subjects"),
        *[F.count(F.when(c & (F.col("y") == y), 1)).alias(f"{name}_{y}") for y in range(3) for name, c in (("train", ~test), ("test", test))],
    )


def bootstrap(cases: DataFrame, repeats: int, seed: int) -> DataFrame:
    """Resamples within classes: ``repeat, y, predicted``, a row for each draw.

    Draw i of a class takes the case whose rank is a hash of (repeat, class, i).
    Only ``predicted`` is looked up: it is broadcast in pages of ranks, one
    value a case, so no draw is shuffled.
    """
    rows = hash_rank(cases.withColumn("_d", digest(F.lit(seed), F.col("id"))), ["y"], "_d").select("y", "rank", "predicted")
    rows = checkpointed(rows.repartition(4 * cases.sparkSession.sparkContext.defaultParallelism))
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    page, place = lambda rank: F.floor((rank - 1) / PAGE), lambda rank: ((rank - 1) % PAGE).cast("int")
    pages = rows.groupBy("y", page(F.col("rank")).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "predicted"))), lambda x: x["predicted"]).alias("kept"))
    draws = rows.select("y", "rank").join(F.broadcast(sizes), "y").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draws = draws.select("repeat", "y", (hash_int(F.lit(seed), F.col("repeat"), F.col("y"), F.col("rank")) % F.col("n") + 1).alias("rank"))
    draws = draws.withColumn("page", page(F.col("rank"))).join(F.broadcast(checkpointed(pages)), ["y", "page"])
    return draws.select("repeat", "y", F.get("kept", place(F.col("rank"))).alias("predicted"))
