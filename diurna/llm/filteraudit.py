"""How filters interact: what each removes, in every order of applying them.

``scan`` reads Arrow buffers of texts: byte classes and prefix sums count words,
capitals, symbols and code points; the words of each text, sorted by hash, give
its distinct words, where words of one hash are compared byte by byte.  A text's
failures are bits of a mask.  Which filter removes a text in which order depends
on its mask alone, so texts are counted by part and mask, and all 120 orders are
read off these counts: at most 32 for each part, however many rows there are.

Nulls: a null text counts as empty, a null source as the empty string, a row
without a key has no smaller key and no label.  Repeated rows (one key, one
text) don't fail for each other.  A label is set if any label row of the key
sets it.  An empty table has no parts and so no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .textbatch import EXACT, NOT_SPACE, _quoted, span_hashes, with_columns, words

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Percent of words that must be distinct, and of code points that may be capitals.
MIN_DISTINCT, MAX_CAPITALS = 50, 2

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[0x41:0x5B] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|")] = True
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False

COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")


def per_row(members: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Members of a byte class in each row, by prefix sums."""
    sums = np.zeros(len(members) + 1, np.int64)
    np.cumsum(members, out=sums[1:])
    return np.diff(sums[offsets])


def distinct_words(data: np.ndarray, offsets: np.ndarray, hashes=span_hashes) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each row, compared with case.

    Words are sorted by row and hash.  Neighbours of one hash are compared byte
    by byte; a row in which two of them differ is counted word by word.
    """
    w = words(data, offsets, NOT_SPACE)
    if not len(w):
        return w.count, w.count.copy()
    rows = len(offsets) - 1
    shift = np.uint64(64 - max(1, int(rows - 1).bit_length()))
    key = (w.doc.astype(np.uint64) << shift) | (hashes(data, w.start, w.end, EXACT) & ((np.uint64(1) << shift) - np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    distinct = w.count - np.bincount(w.doc[order[again + 1]], minlength=rows)
    one, two = order[again], order[again + 1]
    for row in np.unique(w.doc[one[~_equal(data, w.start[one], w.end[one], w.start[two], w.end[two])]]):
        of = slice(w.first[row], w.first[row] + w.count[row])
        distinct[row] = len({data[a:b].tobytes() for a, b in zip(w.start[of], w.end[of], strict=True)})
    return w.count, distinct


def _equal(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether spans hold the same bytes; eight at a time, long ones as a whole."""
    length = a_end - a
    same = length == b_end - b
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    todo = np.flatnonzero(same & (length <= 64))
    at = 0
    while len(todo):
        mask = masks[np.minimum(length[todo] - at, 8)]
        same[todo] &= ((eight[a[todo] + at] ^ eight[b[todo] + at]) & mask) == 0
        at += 8
        todo = todo[length[todo] > at]
    for i in np.flatnonzero(same & (length > 64)):
        same[i] = np.array_equal(data[a[i] : a_end[i]], data[b[i] : b_end[i]])
    return same


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts that filters need (``COUNTS``); whole texts, no shuffle."""

    def add(data, offsets):
        n_words, n_distinct = distinct_words(data, offsets)
        counts = [n_words, n_distinct, per_row(_CAPITAL[data], offsets), per_row(_SYMBOL[data], offsets), per_row(_LEAD[data], offsets)]
        return [pa.array(c, pa.int64()) for c in counts]

    return with_columns(docs, text, add, [(c, "long") for c in COUNTS], keep)


def text_mask(min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT, max_capitals: int = MAX_CAPITALS) -> Column:
    """Bits of the filters A to D that a scanned text fails."""
    fails = [
        F.col("n_words") < min_words,
        100 * F.col("n_distinct") < min_distinct * F.col("n_words"),
        100 * F.col("n_capitals") > max_capitals * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows counted by ``part`` and ``mask`` of failures; ``n``, ``n_good`` and ``n_toxic``.

    Texts leave the plan in the first pass: what is shuffled is a key, a
    digest, a part and a mask a row, counted before each shuffle.
    """
    source = docs.select(
        _quoted(key).alias("key"),
        F.coalesce(_quoted(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(_quoted(text), F.lit("")), 256)).alias("digest"),
        _quoted(text).alias("text"),
    )
    seen = scan(source, "text", ["key", "part", "digest"]).withColumn("mask", text_mask())
    seen = materialize(seen.groupBy("key", "part", "digest", "mask").agg(F.count("*").alias("n")))
    first = seen.filter(F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("key"), F.lit(True).alias("first"))
    marked = labels.groupBy(_quoted(key).alias("key")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("bad"))
    keyed = seen.filter(F.col("key").isNotNull())
    keyed = keyed.join(first, ["key", "digest"], "left").join(marked.filter(F.col("key").isNotNull()), "key", "left")
    keyed = keyed.withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(16))
    bare = seen.filter(F.col("key").isNull()).withColumns({"good": F.lit(None).cast("long"), "bad": F.lit(None).cast("long")})
    both = keyed.select("part", "mask", "n", "good", "bad").unionByName(bare.select("part", "mask", "n", "good", "bad"))
    return both.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("n_good"),
        F.sum(F.col("n") * F.coalesce("bad", F.lit(0))).alias("n_toxic"),
    )


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of ``filters`` and step: what the step's filter does.

    ``counts``: rows by ``part`` and ``mask``.  A part has a row for each order
    and step even where all its counts are zero.
    """
    every = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    share = int(np.prod(range(1, len(filters) + 1)))  # orders; a filter is first of k in one of k of them
    steps = (
        counts.withColumn("filter_order", F.explode(every))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
        .withColumn("bit", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"))
        .withColumn("before", F.expr("aggregate(sequence(0, step - 1), 0, (m, i) -> m + IF(i = 0, 0, shiftleft(1, ascii(substring(filter_order, i, 1)) - 65)))"))
    )
    gone, fails = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    here = ~gone & fails

    def total(when: Column, n: str = "n") -> Column:
        return F.sum(F.when(when, F.col(n)).otherwise(0)).cast("long")

    return steps.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        total(~gone & ~fails).alias("kept"),
        total(here).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "n_good").alias("good_lost"),
        total(here, "n_toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr(f"{share} div bit_count(mask)")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Five filters in all their orders over whole texts, for each part of ``docs``."""
    return orders(masks(docs, labels, key, text, part))
