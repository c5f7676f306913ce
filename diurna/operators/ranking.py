"""Running totals in the order of a score, without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

BUCKETS = 64


def running_totals(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Add ``cum_<s>``: the total of ``s`` up to and with each row's score.

    Rows of one score should be aggregated before.  Rows are cut at approximate
    quantiles; each bucket is summed by itself and shifted by the totals of the
    buckets before, of which a group has ``buckets`` at most.
    """
    by = list(by)
    # written once: approximate quantiles computed again may differ, and then totals and rows would
    cuts = checkpointed(df.groupBy(*by).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000).alias("_cuts")))
    rows = df.join(cuts, by).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    key = F.col(order).desc() if descending else F.col(order).asc()
    turn = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*by).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*by, "_bucket", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums])
    inside = Window.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(shift, [*by, "_bucket"])
    return out.select(*[c for c in df.columns], *[(F.sum(s).over(inside) + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums])


def midpoints(df: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Middles between neighbours of the distinct values, 1 before the first and 1 after the last.

    Values are cut at approximate quantiles; a bucket's last value meets the
    first of the next one that has any.  Nulls are left out; no values, no rows.
    """
    rows = df.select(F.col(value).alias("_v")).filter("_v is not null").distinct()
    cuts = checkpointed(rows.agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 1000).alias("_cuts")))  # one row, the same for all that read it
    rows = rows.join(F.broadcast(cuts)).select("_v", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0)).alias("_bucket"))
    ends = rows.groupBy("_bucket").agg(F.min("_v").alias("_first"))
    ends = ends.select("_bucket", F.lead("_first").over(Window.orderBy("_bucket")).alias("_next"), (F.row_number().over(Window.orderBy("_bucket")) == 1).alias("_lowest"))  # a row for each bucket
    inside = Window.partitionBy("_bucket").orderBy("_v")
    out = rows.withColumns({"_follows": F.lead("_v").over(inside), "_i": F.row_number().over(inside)}).join(F.broadcast(ends), "_bucket")
    follows = F.coalesce("_follows", "_next")
    middle = F.coalesce((F.col("_v") + follows) / 2, F.col("_v") + 1)
    lowest = F.col("_lowest") & (F.col("_i") == 1)
    return out.select(F.explode(F.when(lowest, F.array(F.col("_v") - 1, middle)).otherwise(F.array(middle))).alias(value))


def hash_rank(df: DataFrame, by: Sequence[str], digest: str) -> DataFrame:
    """Add ``rank`` from 1 in the order of a hexadecimal digest, by its first two digits."""
    by = list(by)
    rows = df.withColumn("_bucket", F.substring(digest, 1, 2))
    totals = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(digest)
    return rows.withColumn("_i", F.row_number().over(inside)).join(shift, [*by, "_bucket"]).withColumn("rank", F.col("_i") + F.col("_before")).drop("_bucket", "_i", "_before")
