"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of all nodes with an edge; the component is its least node.

    Large-star and small-star rounds: each node ties its larger neighbours,
    then its smaller ones and itself, to the least of them, until nothing
    changes.  The number of edges never grows, stars keep the rounds about
    logarithmic in the longest path, and every round is a table in the shared
    folder.  Self-edges and nulls are ignored.
    """
    now = materialize(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .filter((F.col("a").isNotNull()) & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own: the join then has an exchange that skew handling can split
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        # every edge now points from the larger to the smaller node
        large = materialize(large)
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = materialize(small.filter(F.col("a") != F.col("b")).distinct())
        then, mark = mark, _mark(now)
        if then == mark:
            break
    # stars: each node but the centre has one edge, to the centre
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(r)
