"""Benchmark decontamination by suffix arrays over the training texts.

Every shard (a few megabytes of documents inside a task) gets a suffix array of
its words, and every test suffix is binary-searched in it: the suffixes that
share a window with it stand side by side, and the longest verbatim match of a
place is shared with one of its neighbours.  The array is built by doubling:
from the order of suffixes by their first k words follows that by 2k.

The benchmark goes to all tasks in blocks of a fixed size.  The documents are
read once; a worker searches each shard for one block after the other.

A shard's array leaves out suffixes that cannot match: those whose first few
words occur nowhere in the block in that order; so do the searches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import arrow_batches, materialize
from .textbatch import ALNUM, Words, _quoted, runs, span_hashes, text_bytes, with_columns, words

WINDOW = 13
#: UTF-8 bytes of benchmark texts in a broadcast block, about; one longer item
#: is a block of its own.  A block takes at most 20 bytes for each of them.
BLOCK_BYTES = 4 << 20
#: UTF-8 bytes of a shard; one longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Contaminated: at least one word in this many is hit.
HIT_SHARE = 20
_BITS = 20


@dataclass
class Block:
    """Some items, the words of all one after the other."""

    items: list  # in their own order
    names: list[str]
    numbers: np.ndarray  # of the words, from 1
    vocabulary: np.ndarray  # sorted hashes of the words, by number
    item: np.ndarray  # of each word
    end: np.ndarray  # of each item
    window: np.ndarray  # words of each item's window
    gram: int  # words by which suffixes are picked
    grams: np.ndarray  # sorted hashes of all n-grams of that length
    order: np.ndarray  # their places
    bitmap: np.ndarray

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Places of all the given n-grams, sorted."""
        low, high = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        return np.sort(self.order[_ranges(low, high)]).astype(np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _block(items: list, texts: pa.Array, window: int) -> Block:
    data, offsets = text_bytes(texts)
    w = words(data, offsets, ALNUM)
    hashes = span_hashes(data, w.start, w.end)
    vocabulary = np.unique(hashes)
    # an item of fewer words than the window is one window
    windows = np.minimum(w.count, window)
    gram = int(min(3, windows[windows > 0].min())) if len(w) else 1
    grams = runs(hashes, gram)
    at = np.flatnonzero(w.doc[: len(grams)] == w.doc[gram - 1 :]) if len(grams) else np.zeros(0, np.int64)
    at = at[np.argsort(grams[at], kind="stable")]
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(grams[at] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    numbers = (np.searchsorted(vocabulary, hashes) + 1).astype(np.int32)
    names = [None if x is None else str(x) for x in items]
    return Block(items, names, numbers, vocabulary, w.doc.astype(np.int32), w.first + w.count, windows, gram, grams[at], at.astype(np.int32), bitmap)


def _member(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if len(sorted_values) == 0:
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values


def _covered(at: np.ndarray, width: int, size: int) -> np.ndarray:
    """Places of ``width`` words from each place on."""
    flag = np.zeros(size, bool)
    for i in range(width):
        flag[at + i] = True
    return np.flatnonzero(flag)


class Suffixes:
    """Order of suffixes of number sequences, by doubling.

    ``follows[i]``: number i + 1 goes on the sequence of number i.
    """

    def __init__(self, numbers: np.ndarray, follows: np.ndarray) -> None:
        n = len(numbers)
        places = np.arange(n)
        stops = np.flatnonzero(~follows)
        #: numbers from each place on
        self.left = stops[np.searchsorted(stops, places)] - places + 1
        self.ranks = [np.unique(numbers, return_inverse=True)[1] + 1]
        k = 1
        while k < self.left.max() and self.ranks[-1].max() < n:
            last = self.ranks[-1]
            # suffixes that end here come first
            after = np.where(self.left > k, last[np.minimum(places + k, n - 1)], 0)
            self.ranks.append(np.unique(last * (n + 1) + after, return_inverse=True)[1] + 1)
            k *= 2

    @property
    def order(self) -> np.ndarray:
        """Rank of each suffix; equal ones share it."""
        return self.ranks[-1]

    def heads(self, at: np.ndarray, length: int) -> np.ndarray:
        """Keys of the first ``length`` numbers of suffixes that have as many.

        Keys of equal heads are equal, and they sort as the suffixes do.
        """
        k = min(length.bit_length(), len(self.ranks)) - 1
        rank = self.ranks[k]
        if 1 << k + 1 <= length:  # longer heads: all suffixes differ by then, or end
            return rank[at]
        return rank[at] * (len(rank) + 1) + rank[at + length - (1 << k)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers two suffixes have in common at their beginning."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        open_ = np.ones(len(a), bool)
        last = len(self.left) - 1
        for k in reversed(range(len(self.ranks))):
            rank = self.ranks[k]
            same = np.flatnonzero(open_ & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)]))
            left = np.minimum(self.left[a[same]], self.left[b[same]])
            out[same] += np.minimum(1 << k, left)
            open_[same[left <= 1 << k]] = False  # one ends here
            a[same] += 1 << k
            b[same] += 1 << k
        return out


@dataclass
class Found:
    """What a shard shares with a block."""

    hits: list[tuple[np.ndarray, int]]  # first words of hit windows, and their length
    rows: np.ndarray  # with the items below
    items: np.ndarray
    best: list[tuple[int, int, int, int, int]]  # row, words, item, word of the shard, word of the item


def _search(b: Block, w: Words, hashes: np.ndarray) -> Found | None:
    """All windows of a block in a shard, and each row's longest match that holds one."""
    if len(hashes) < b.gram or not len(b.grams):
        return None
    grams = runs(hashes, b.gram)
    at = np.flatnonzero(b.bitmap[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
    at = at[w.doc[at] == w.doc[at + b.gram - 1]]
    at = at[_member(grams[at], b.grams)]
    if len(at) == 0:
        return None
    suffix = b.places(np.unique(grams[at]))
    mine, theirs = _covered(at, b.gram, len(hashes)), _covered(suffix, b.gram, len(b.numbers))
    number = np.searchsorted(b.vocabulary, hashes[mine])
    number = np.where(b.vocabulary[np.minimum(number, len(b.vocabulary) - 1)] == hashes[mine], number + 1, 0)
    owner = [w.doc[mine], b.item[theirs]]
    follows = [np.append((np.diff(x) == 1) & (o[1:] == o[:-1]), False) for x, o in zip((mine, theirs), owner, strict=True)]
    s = Suffixes(np.concatenate([number, b.numbers[theirs]]), np.concatenate(follows))
    array = np.searchsorted(mine, at)
    array = array[np.argsort(s.order[array], kind="stable")]
    asked = np.searchsorted(theirs, suffix) + len(mine)
    window = b.window[b.item[suffix]]
    found = Found([], np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    pairs, longest = [], []
    for n in np.unique(window).tolist():
        q = asked[(window == n) & (s.left[asked] >= n)]
        p = array[s.left[array] >= n]
        keys, want = s.heads(p, n), s.heads(q, n)
        low, high = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
        q, want = q[high > low], want[high > low]
        p, keys = p[_member(keys, np.unique(want))], keys[_member(keys, np.unique(want))]
        if len(q) == 0:
            continue
        found.hits.append((mine[p], n))
        # rows and items of each window, once
        items = np.unique(np.stack([want, b.item[theirs[q - len(mine)]]]), axis=1)
        rows = np.unique(np.stack([keys, w.doc[mine[p]]]), axis=1)
        low, high = np.searchsorted(rows[0], items[0], "left"), np.searchsorted(rows[0], items[0], "right")
        pairs.append(np.stack([rows[1][_ranges(low, high)], np.repeat(items[1], high - low)]))
        # the nearest test suffixes have the longest match
        q = q[np.argsort(s.order[q], kind="stable")]
        spot = np.searchsorted(s.order[q], s.order[p])
        both = [s.common(p, q[np.clip(spot + d, 0, len(q) - 1)]) for d in (-1, 0)]
        longest.append((p, q, np.maximum(*both)))
    if not pairs:
        return None
    found.rows, found.items = np.unique(np.concatenate(pairs, axis=1), axis=1)
    most = np.zeros(len(w.count), np.int64)
    for p, _, n in longest:
        np.maximum.at(most, w.doc[mine[p]], n)
    for p, q, n in longest:
        row = w.doc[mine[p]]
        for length in np.unique(n[n == most[row]]).tolist():
            top = np.flatnonzero((n == length) & (most[row] == length))
            # the first place of each row's longest heads, the first item and place of each head
            heads = s.heads(p[top], length)
            order = np.lexsort((mine[p[top]], heads, row[top]))
            new = np.append(True, (np.diff(heads[order]) != 0) | (np.diff(row[top][order]) != 0))
            top, heads = top[order[new]], heads[order[new]]
            own = q[s.left[q] >= length]
            there = theirs[own - len(mine)]
            keys = s.heads(own, length)
            order = np.lexsort((there, b.item[there], keys))
            keys, there = keys[order], there[order]
            there = there[np.searchsorted(keys, heads)]
            found.best += zip(row[top].tolist(), [length] * len(top), b.item[there].tolist(), mine[p[top]].tolist(), there.tolist(), strict=True)
    return found


def _scan(blocks: list, data: np.ndarray, offsets: np.ndarray, item_type: pa.DataType) -> list[pa.Array]:
    """A shard searched for all blocks (broadcasts)."""
    rows = len(offsets) - 1
    w = words(data, offsets, ALNUM)
    hashes = span_hashes(data, w.start, w.end)
    inside = np.zeros(len(w), bool)
    items: list[set[str]] = [set() for _ in range(rows)]
    best: list[tuple | None] = [None] * rows
    for block in blocks:
        b = block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)  # or the worker would keep every block
        found = _search(b, w, hashes)
        if found is None:
            continue
        for place, n in found.hits:
            delta = np.zeros(len(w) + 1, np.int64)
            np.add.at(delta, place, 1)
            np.add.at(delta, place + n, -1)
            inside |= np.cumsum(delta[:-1]) > 0
        for r, i in zip(found.rows.tolist(), found.items.tolist(), strict=True):
            if b.names[i] is not None:
                items[r].add(b.names[i])
        for r, n, i, at, there in found.best:
            # the longest, then the first item (null before all), then the first place
            own = (-n, (b.items[i] is not None, b.items[i]), at - int(w.first[r]), there - int(b.end[i - 1] if i else 0))
            if best[r] is None or own < best[r]:
                best[r] = own
    hit = np.concatenate([[0], np.cumsum(inside)])
    return [
        pa.array(w.count, pa.int64()),
        pa.array(hit[w.first + w.count] - hit[w.first], pa.int64()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array([-x[0] if x else 0 for x in best], pa.int64()),
        pa.array([x[1][1] if x else None for x in best], item_type),
        pa.array([x[2] if x else None for x in best], pa.int64()),
        pa.array([x[3] if x else None for x in best], pa.int64()),
    ]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int, window: int) -> list:
    """Broadcasts of the benchmark in blocks of about ``block_bytes``."""
    spark = benchmark.sparkSession
    rows = benchmark.select(_quoted(item).alias("item"), _quoted(text).alias("text"))
    if not isinstance(rows.schema["item"].dataType, (T.IntegralType, T.StringType)):
        rows = rows.withColumn("item", F.col("item").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    if n > 1:
        rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")).repartition("block").sortWithinPartitions("block"))
    out = []
    for k in range(n):
        own = rows.filter(F.col("block") == k) if n > 1 else rows
        table = own.select("item", "text").orderBy("item", "text").toArrow()  # one block: bounded
        if table.num_rows:
            out.append(spark.sparkContext.broadcast(_block(table["item"].to_pylist(), table["text"].combine_chunks(), window)))
    return out


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents with what they share with the benchmark.

    Adds ``n_words, n_hit`` (words inside any occurrence of a window),
    ``items`` (ids with occurring windows, sorted as strings), ``match_words,
    match_item, match_at, match_item_at`` (the longest verbatim match that
    holds a window, its item, and the words at which it begins in the text and
    in the item; ties: the first item in its own order, then the first place in
    the text, then in the item) and ``contaminated``.  They take the place of
    input columns of the same names.

    Words are runs of letters and digits, A-Z lower-cased.  A window is
    ``window`` consecutive words of an item; an item of fewer, but not none, is
    one window.  Null and empty texts have no words and are clean; an empty
    benchmark leaves every document clean; repeated rows are judged alike; an
    item of a null id hits words but isn't listed.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_batches(docs.sparkSession)
    added = ["n_words", "n_hit", "items", "match_words", "match_item", "match_at", "match_item_at", "contaminated"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    blocks = _blocks(benchmark, item, item_text, block_bytes, window)
    kind = benchmark.select(_quoted(item)).schema[0].dataType
    kind = kind if isinstance(kind, (T.IntegralType, T.StringType)) else T.StringType()
    arrow = to_arrow_type(kind)
    fields = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"), ("match_words", "bigint"), ("match_item", kind.simpleString()), ("match_at", "bigint"), ("match_item_at", "bigint")]
    found = with_columns(docs, text, lambda data, offsets: _scan(blocks, data, offsets, arrow), fields, keep=keep, limit=SHARD_BYTES)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(HIT_SHARE) * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that the benchmark does not contaminate, unchanged."""
    inner = docs.select(F.struct(*[_quoted(c) for c in docs.columns]).alias("_row"), _quoted(options.pop("text", "text")).alias("_body"))
    clean = find_matches(inner, benchmark, text="_body", keep=["_row"], **options).filter(~F.col("contaminated"))
    return clean.select("_row.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: counts, a digest of the items, the verdict.

    Repeated documents have a row each.  Null and empty texts have no words and
    aren't contaminated; null and empty items occur nowhere, nor does anything
    in an empty benchmark.
    """
    found = find_matches(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        "contaminated",
        "match_words",
        F.col("match_item").cast("string").alias("match_item"),
        "match_at",
    )
