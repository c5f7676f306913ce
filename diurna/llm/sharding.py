"""Sharding: weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-buckets of a shard in which slots are numbered; a shard of n rows is
#: numbered by tasks of about n / SLOT_BUCKETS rows.
SLOT_BUCKETS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: the one with the largest weighted score.

    Shard ``s`` scores ``-weight / ln(u)``, ``u`` in (0, 1) being a hash of the
    key and ``s``, so each shard gets a share of keys in proportion to its
    weight; a shard more takes keys only into itself, and a changed weight
    moves keys only to or from that shard.  Shards of weight 0 get nothing.
    Equal scores go to the lower shard.  A null key is hashed as a key of its
    own, so all of them share a shard.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a weight above 0")
    # The hash chain starts from the key's text, so 7 and "7" are one key.
    start = F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null")))
    scored = []
    for shard, weight in enumerate(weights):
        if weight < 0:
            raise ValueError("weights can't be negative")
        if weight == 0:
            continue
        u = (F.shiftrightunsigned(F.xxhash64(start, F.lit(shard)), 11).cast("double") + 0.5) / float(2**53)
        scored.append(F.struct((-float(weight) / F.ln(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-(F.array_max(F.array(*scored))["shard"])).cast("int")


def slots(df: DataFrame, shard: str, order: Sequence[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, as column ``slot``.

    Rows are numbered within hash buckets of a shard and shifted by the rows of
    the buckets before, so no task sees a whole shard.  Rows that agree in all
    ``order`` columns are interchangeable.
    """
    bucket = F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(buckets)).cast("int")
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * buckets rows, whatever the input.
    offsets = sizes.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(offsets), [shard, "_bucket"])
        .withColumn("slot", (F.col("_before") + F.col("_place") - 1).cast("long"))
        .drop("_bucket", "_place", "_before")
    )


def shard_records(
    docs: DataFrame,
    shards: int | Sequence[float] = 16,
    grown: int | Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Place every record in a shard.

    ``shards`` is a number of equal shards or a list of weights; ``grown`` is
    the layout to compare with, by default one more shard of the mean weight.
    Only ``key`` and ``text`` of the input are read, so other columns of any
    name do no harm.

    Returns ``key, size, text_crc32, law, shard, slot, grown_shard``; size is
    the UTF-8 bytes of the text (null: none) plus 1.  An empty table gives an
    empty result; repeated rows each get a slot; rows of a null key share a
    shard.
    """
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if grown is None:
        grown = [*weights, sum(weights) / len(weights)]
    after = [1.0] * grown if isinstance(grown, int) else [float(w) for w in grown]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), after).alias("grown_shard"),
    )
    out = slots(rows, "shard", [key, "size", "text_crc32"])
    return out.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
