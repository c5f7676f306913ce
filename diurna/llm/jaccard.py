"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal sets of word n-grams form one class, so copies cost nothing
further.  Classes that share a band of MinHash values are candidates.  Their
values are compared a few at a time; a pair is dropped once the posterior
probability that its similarity reaches the threshold, given the matches so
far and a uniform prior, falls below a tolerance.  The rest is verified exactly
on the n-gram sets.

Pairs live only inside a task.  Candidates are first joined into components by
the signatures alone; then each component's classes meet block against block,
where all its pairs are pruned and verified and only counts and a spanning
forest leave the task.  A component of more than a block, such as a long chain,
is split by bands where that ships less: classes meet in each band they share,
and a pair counts in the first of them.  So n-gram sets are shipped once for
each block that a class may have links in, not for each block of its component.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import arrow_batches, materialize
from .textbatch import ALNUM, _quoted, chunks, mix64, ngram_rows, seeds, span_hashes, text_bytes, with_columns, words

N = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 21, 3  # a pair at 0.8 shares no band with probability 3e-7
VALUES = BANDS * BAND_ROWS
#: Values compared between two looks at the posterior.
STEP = 9
TOLERANCE = 1e-6
#: Classes of a block; two blocks meet in a task.
BLOCK = 512


def survivors_need(threshold: float, tolerance: float, values: int = VALUES, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on) of each look.

    With k of n values equal, the similarity's posterior under a uniform prior
    is Beta(k + 1, n - k + 1), and P(similarity >= t) = P(Bin(n + 1, t) <= k).
    """
    out = []
    for n in range(step, values + 1, step):
        below, need = 0.0, n + 1
        for k in range(n + 1):
            below += comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
            if below >= tolerance:
                need = k
                break
        out.append((n, need))
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted within rows, and where the rows begin.

    A text of fewer than ``n`` words, but not none, has one: all its words.
    """
    w = words(data, offsets, ALNUM)
    grams, rows = ngram_rows(w, span_hashes(data, w.start, w.end), n, whole=True)
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[keep], rows[keep]
    return grams, np.searchsorted(rows, np.arange(len(offsets)))


def _digests(grams: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, equal for equal sets; None for empty ones."""
    total = np.zeros((2, len(grams) + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix64(grams), out=total[0, 1:])
        np.cumsum(mix64(grams ^ np.uint64(0x9E3779B97F4A7C15)), out=total[1, 1:])
        sums = (total[:, starts[1:]] - total[:, starts[:-1]]).T
    return [s.tobytes() if n else None for s, n in zip(np.ascontiguousarray(sums), np.diff(starts), strict=True)]


def _signatures(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of each non-empty set, as rows of uint32.

    Each function mixes ``x xor c`` anew.  Without mixing, functions whose ``c``
    begin alike would pick the same element, and on small sets one element
    could win half of them.
    """
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, VALUES), np.uint32)
    for j, c in enumerate(seeds(VALUES, 91)):
        if len(full):
            low = np.minimum.reduceat(mix64(grams ^ c), starts[full])
            out[full, j] = (mix64(low) >> np.uint64(32)).astype(np.uint32)
    return out


def _sketch(data: np.ndarray, offsets: np.ndarray, n: int) -> list[pa.Array]:
    grams, starts = _sets(data, offsets, n)
    digests, signatures = _digests(grams, starts), _signatures(grams, starts)
    empty = [d is None for d in digests]
    return [
        pa.array(digests, pa.binary()),
        pa.array(np.diff(starts), pa.int64()),
        pa.array([None if e else s.tobytes() for e, s in zip(empty, signatures, strict=True)], pa.binary()),
    ]


def _bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    out = np.empty((len(signatures), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(signatures), b + 1, np.uint64)
            for r in range(BAND_ROWS):
                key = mix64(key) + signatures[:, b * BAND_ROWS + r].astype(np.uint64)
            out[:, b] = mix64(key)
    return out


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)


def _pairs(a: np.ndarray, b: np.ndarray, same: bool, need: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that the Bayesian comparison keeps; i < j if ``same``."""
    n, k = need[0]
    match = np.zeros((len(a), len(b)), np.uint8)
    for v in range(n):
        match += a[:, v, None] == b[None, :, v]
    keep = match >= k
    if same:
        keep = np.triu(keep, 1)
    i, j = np.nonzero(keep)
    count = match[i, j].astype(np.int64)
    for last, k in need[1:]:
        count += (a[i, n:last] == b[j, n:last]).sum(1)
        n = last
        go = count >= k
        i, j, count = i[go], j[go], count[go]
    return i, j


def _forest(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Least node of each node's component."""
    label = np.arange(size)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(batches, keys: list[str]):
    """Consecutive rows with equal keys, as tables; the input is sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            v = pa.compute.rank(c, sort_keys="ascending", tiebreaker="dense").to_numpy() if not pa.types.is_integer(c.type) else c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a].as_py() for c in columns)
            if key != last and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            last = key
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _in_blocks(rows: DataFrame, group: list[str], by: str, size: str) -> DataFrame:
    """Send every row to all pairs of blocks that its block belongs to.

    Adds ``_i, _j`` (the pair, i <= j) and ``_side`` (the row's block).
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(BLOCK)).cast("int"))
    own = F.pmod(F.xxhash64(by), blocks).cast("int")
    rows = rows.withColumn("_side", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("_i", F.least("_side", "_other")).withColumn("_j", F.greatest("_side", "_other")).drop("_other", size)
    keys = [*group, "_i", "_j"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    i, side = table["_i"][0].as_py(), table["_side"].to_numpy()
    if i == table["_j"][0].as_py():
        all_rows = np.arange(table.num_rows)
        return all_rows, all_rows, True
    return np.flatnonzero(side == i), np.flatnonzero(side != i), False


def _shared_bands(classes: DataFrame) -> DataFrame:
    """``band, digest, n`` of the bands that n > 1 classes share."""

    def keys(batches):
        for part in batches:
            bands = _bands(_matrix(part.column("signature"), VALUES, np.uint32))
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))], ["digest", "bands"])

    entries = classes.select("digest", "signature").mapInArrow(keys, "digest binary, bands array<long>").select("digest", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return materialize(entries.join(shared, "band"))


def _candidate_edges(near: DataFrame, classes: DataFrame, need: list[tuple[int, int]]) -> DataFrame:
    """Spanning forests of the pairs that the signatures alone can't rule out."""
    near = near.join(classes.select("digest", "signature"), "digest")

    def compare(batches):
        for table in _groups(batches, ["band", "_i", "_j"]):
            a, b, same = _sides(table)
            m = _matrix(table["signature"], VALUES, np.uint32)
            i, j = _pairs(m[a], m[b], same, need)
            label = _forest(a[i], b[j], table.num_rows)
            child = np.flatnonzero(label != np.arange(table.num_rows))
            if len(child):
                d = table["digest"].combine_chunks()
                yield pa.RecordBatch.from_arrays([d.take(pa.array(child)), d.take(pa.array(label[child]))], ["a", "b"])

    return _in_blocks(near, ["band"], "digest", "n").mapInArrow(compare, "a binary, b binary")


def _overlaps(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[j]."""
    if len(i) <= 256:
        return np.array([len(np.intersect1d(grams[a[x]], grams[b[y]], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    out = np.zeros(len(i), np.int64)
    rows = np.union1d(a, b)
    size = np.array([len(grams[r]) for r in rows])
    flat = np.concatenate([grams[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count > 1  # others are in no intersection
    number = np.cumsum(common) - 1
    keep = common[inverse]
    column, owner = number[inverse[keep]], owner[keep]
    ra, rb = np.searchsorted(rows, a), np.searchsorted(rows, b)
    width = 4096
    for first in range(0, int(common.sum()), width):
        here = (column >= first) & (column < first + width)
        dense = np.zeros((len(rows), min(width, int(common.sum()) - first)), np.float32)
        dense[owner[here], column[here] - first] = 1
        out += (dense[ra] @ dense[rb].T)[i, j].astype(np.int64)
    return out


def _meetings(member: DataFrame, near: DataFrame) -> DataFrame:
    """Where classes meet: ``digest, component, band, size``.

    In their component, as band 0, or in its bands where that ships less; size
    counts those who meet.
    """
    whole = member.select("digest", "component", F.lit(0).cast("long").alias("band"), "size")
    large = member.filter(F.col("size") > BLOCK).select("digest", "component", "size")
    if large.isEmpty():
        return whole
    bands = near.join(large, "digest").groupBy("component", "band").agg(F.count(F.lit(1)).alias("m"), F.max("size").alias("g"))
    bands = materialize(bands.filter("m > 1"))

    def shipped(n):
        return F.col(n) * F.ceil(F.col(n) / F.lit(BLOCK))

    split = bands.groupBy("component").agg(F.sum(shipped("m")).alias("by_band"), F.max(shipped("g")).alias("at_once")).filter("by_band < at_once").select("component")
    split = materialize(split)
    if split.isEmpty():
        return whole
    parts = bands.join(split, "component").select("component", "band", F.col("m").alias("size"))
    apart = near.select("digest", "band").join(large.select("digest", "component"), "digest").join(parts, ["component", "band"])
    return whole.join(split, "component", "left_anti").select("digest", "component", "band", "size").unionByName(apart.select("digest", "component", "band", "size"))


def _verified(members: DataFrame, need: list[tuple[int, int]], threshold: float) -> DataFrame:
    """For each meeting and block pair: linked classes, their copies, an edge.

    ``members``: component, band, size, digest, copies, signature, grams.
    """

    def compare(batches):
        for table in _groups(batches, ["component", "band", "_i", "_j"]):
            a, b, same = _sides(table)
            m = _matrix(table["signature"], VALUES, np.uint32)
            i, j = _pairs(m[a], m[b], same, need)
            band = table["band"][0].as_py()
            if band and len(i):
                # the pair counts in the first band it shares
                keys = _bands(m).view(np.int64)
                first = np.argmax(keys[a[i]] == keys[b[j]], axis=1)
                once = keys[a[i], first] == band
                i, j = i[once], j[once]
            if len(i) == 0:
                continue
            grams = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
            size = np.array([len(g) for g in grams])
            both = _overlaps(grams, a, b, i, j)
            ok = both >= threshold * (size[a[i]] + size[b[j]] - both) - 1e-9
            i, j = a[i[ok]], b[j[ok]]
            copies = table["copies"].to_numpy()
            links = np.bincount(i, minlength=len(size)) + np.bincount(j, minlength=len(size))
            docs = np.bincount(i, weights=copies[j], minlength=len(size)) + np.bincount(j, weights=copies[i], minlength=len(size))
            label = _forest(i, j, len(size))
            some = np.flatnonzero(links)
            if len(some):
                d = table["digest"].combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [d.take(pa.array(some)), d.take(pa.array(label[some])), pa.array(links[some].astype(np.int64)), pa.array(docs[some].astype(np.int64))],
                    ["digest", "to", "links", "docs"],
                )

    return _in_blocks(members, ["component", "band"], "digest", "size").mapInArrow(compare, "digest binary, to binary, links long, docs long")


def _classes(docs: DataFrame, key: str, text: str, n: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Rows with the digest of their n-gram set, and what is known of each set.

    The first: ``key, tid, digest``, where ``tid`` is a hash of the text.  The
    second: ``digest, first`` (the least key among its rows, nulls last, and
    that row's ``tid``), ``copies, linked`` and ``class_first``, the least
    ``first`` that links lead to.
    """
    arrow_batches(docs.sparkSession)
    need = survivors_need(threshold, tolerance)
    base = docs.select(_quoted(key).alias("key"), _quoted(text).alias("text")).select("key", F.xxhash64("text").alias("tid"), "text")
    sketch = with_columns(
        base, "text", lambda data, offsets: _sketch(data, offsets, n), [("digest", "binary"), ("size", "bigint"), ("signature", "binary")], keep=["key", "tid"]
    )
    sketch = materialize(sketch)
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tid"))
    classes = materialize(
        sketch.filter(F.col("digest").isNotNull()).groupBy("digest").agg(least.alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("signature").alias("signature"))
    )
    near = _shared_bands(classes)
    candidates = connected_components(_candidate_edges(near, classes, need))
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    member = candidates.withColumnRenamed("node", "digest").join(sizes, "component").join(classes, "digest")
    member = materialize(member)
    # fetch the texts of one document of each class, and its n-grams again
    wanted = member.select(F.col("first.key").alias("k"), F.col("first.tid").alias("t"), F.col("digest").alias("want"))
    found = base.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("tid") == F.col("t")))

    def regrown(batches):
        for part in chunks(batches, "text"):
            grams, starts = _sets(*text_bytes(part.column("text")), n)
            same = [r for r, (d, w) in enumerate(zip(_digests(grams, starts), part.column("want").to_pylist(), strict=True)) if d == w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column("want")[r].as_py() for r in same], pa.binary()), pa.array([grams[starts[r] : starts[r + 1]].tobytes() for r in same], pa.binary())],
                ["digest", "grams"],
            )

    grams = found.select("want", "text").mapInArrow(regrown, "digest binary, grams binary").dropDuplicates(["digest"])
    joined = _meetings(member, near).join(member.select("digest", "copies", "signature"), "digest").join(grams, "digest")
    links = materialize(_verified(joined, need, threshold))
    groups = connected_components(links.select(F.col("digest").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "digest")
    counts = links.groupBy("digest").agg(F.sum("docs").alias("linked"))
    per_class = classes.select("digest", "first", "copies").join(groups, "digest", "left").join(counts, "digest", "left")
    names = per_class.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("class_first"))
    per_class = per_class.join(names, "component", "left").select(
        "digest", "first", "copies", F.coalesce("class_first", "first").alias("class_first"), F.coalesce("linked", F.lit(0)).alias("linked")
    )
    return sketch.select("key", "tid", "digest"), per_class


def join_similar(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Link documents whose sets of word n-grams have a Jaccard of ``threshold`` or more.

    Returns for each row ``key, class_id, rep_id, n_copies, n_links``:
    ``rep_id`` is the least key among texts of the same n-gram set and
    ``n_copies`` their number; ``n_links`` counts the other documents linked to
    this one, copies included; ``class_id`` is the least key that links lead
    to.  Words are runs of letters and digits, lower-cased in ASCII.  A text of
    fewer than ``n`` words counts as one n-gram.  Texts without words (null,
    empty) are linked to nothing: their class is their own key, their copies 1.
    Repeated rows are copies of each other.  Rows of a null key are linked like
    others; nulls come last, so a class's id is null only if all its keys are.
    """
    rows, per_class = _classes(docs, key, text, n, threshold, tolerance)
    return rows.join(per_class, "digest", "left").select(
        F.col("key").alias(key),
        F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("class_first.key")).alias("class_id"),
        F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("first.key")).alias("rep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
    )


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One document of each class stays: the one of the least key, nulls last.

    Of several rows with that key the one stays whose text has the least hash;
    of rows equal in key and text any one.  Texts without words are in no class
    and all stay.
    """
    found, per_class = _classes(docs, key, text, n, threshold, tolerance)
    kept = per_class.filter(F.col("first") == F.col("class_first")).select(F.col("first.key").alias("k"), F.col("first.tid").alias("t"), F.lit(True).alias("kept"))
    rows = docs.select(F.struct(*[_quoted(c) for c in docs.columns]).alias("row"), _quoted(key).alias("key"), F.xxhash64(_quoted(text)).alias("tid"), _quoted(text).alias("text"))
    rows = rows.withColumn("worded", F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False)))
    rows = rows.select("row", "key", "tid", "worded").join(kept, F.col("key").eqNullSafe(F.col("k")) & (F.col("tid") == F.col("t")) & F.col("worded"), "left")
    repeated = found.filter(F.col("digest").isNotNull()).groupBy("key", "tid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    one = rows.filter("kept")
    if not repeated.isEmpty():  # rows are compared only where they do repeat
        one = one.dropDuplicates(["key", "tid"])
        return one.select("row.*").unionByName(rows.filter("not worded").select("row.*"))
    return rows.filter("kept or not worded").select("row.*")
