"""Document fingerprints: Order MinHash, in DataFrame expressions only.

A text is cut into tokens, tokens into k-mers.  A k-mer's n-th occurrence
counts as an element of its own, so repeats matter.  Each of ``m`` hash
functions selects the ``l`` smallest elements; their hashes, put back in text
order, form one slot of the signature.  Two texts agree in a slot only if they
share the selected k-mers *in the same order*, which is what edit distance, as
opposed to Jaccard similarity, is about.

Function ``j`` ranks the elements of its own part of the hash range, told by
their top bits, before all others; within the part by the element, the others
by a hash seeded with ``j``.  So every function is an order of its own of all
elements, min-wise uniform, whatever the text's length, and the functions of a
short text don't lean on each other.  The elements are sorted once: where a part
holds ``l`` elements, a function's are a slice of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens are runs of other than white space, cut after so many characters.
TOKEN_CHARS = 12
K = 3  # tokens of a k-mer
L = 2  # elements selected by a hash function
M = 32  # hash functions
#: Low bits of an element that hold its place; places beyond wrap around.
PLACE_BITS = 24

_PLACE = (1 << PLACE_BITS) - 1
_HASH = ((1 << 63) - 1) ^ _PLACE  # the sign bit stays 0, so orders agree
_FIRST = -(1 << 63)  # the sign bit, which sorts before all without it


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _part_shift(m: int) -> int:
    """Bits below those that tell an element's part: there are at least ``m`` parts."""
    return 63 - max(1, (m - 1).bit_length())


def order_minhash(text: Column, m: int = M, k: int = K, l: int = L) -> Column:  # noqa: E741
    """Signature of a text: an array of ``m`` longs.

    A text of fewer than ``k`` tokens has one k-mer, all its tokens; a text
    without tokens (null, empty, white space) has the signature of zeros.
    Where there are fewer than ``l`` elements, all are selected.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(\S{{1,{TOKEN_CHARS}}})"), 1)

    def kmers(t: Column) -> Column:
        n = F.size(t)
        some = F.transform(
            F.sequence(F.lit(0), n - F.lit(k)),
            lambda i: F.xxhash64(*[F.get(t, i + F.lit(d)) for d in range(k)]).bitwiseAND(F.lit(_HASH)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_PLACE))),
        )
        one = F.transform(F.array(F.lit(0)), lambda _: F.xxhash64(t).bitwiseAND(F.lit(_HASH)))
        return F.sort_array(F.when(n >= k, some).otherwise(one))

    def elements(s: Column) -> Column:
        """Number the occurrences of equal k-mers, neighbours in sorted ``s``."""
        n = F.size(s)
        again = F.transform(s, lambda x, i: F.coalesce(x.bitwiseXOR(F.get(s, i - 1)) <= F.lit(_PLACE), F.lit(False)))

        def numbered(f: Column) -> Column:
            firsts = F.filter(s, lambda _, i: ~F.get(f, i))

            def repeats(r: Column) -> Column:
                # r: places in s of repeats; those of one k-mer follow each other
                heads = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda q: ~F.coalesce(F.get(r, q) == F.get(r, q - 1) + 1, F.lit(False)))
                return _let(
                    heads,
                    lambda hs: F.flatten(
                        F.transform(
                            hs,
                            lambda q, j: F.transform(
                                F.slice(r, q + 1, F.coalesce(F.get(hs, j + 1), F.size(r)) - q),
                                lambda i, o: _let(F.get(s, i), lambda x: _numbered(x, o + 1)),
                            ),
                        )
                    ),
                )

            later = _let(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(f, i)), repeats)
            return F.when(~F.array_contains(f, True), s).otherwise(F.sort_array(F.concat(firsts, later)))

        return _let(again, numbered)

    def slots(e: Column) -> Column:
        """e: sorted elements, so the parts by top bits are slices."""
        shift = _part_shift(m)
        parts = F.transform(e, lambda x: F.shiftright(x, shift).cast("int"))

        def pick(present: Column, begins: Column) -> Column:
            picked = []
            for j in range(m):
                p = F.array_position(present, F.lit(j)).cast("int")
                at, to = F.get(begins, p - 1), F.coalesce(F.get(begins, p), F.size(e) + 1)
                ranked = F.slice(F.sort_array(F.transform(e, _ranking(j, shift))), 1, l)
                picked.append(_slot(F.when((p > 0) & (to - at >= l), F.slice(e, at, l)).otherwise(ranked), l))
            return F.array(*picked)

        return _let(
            parts,
            lambda part: _let(
                F.filter(F.sequence(F.lit(1), F.size(part)), lambda i: ~F.coalesce(F.get(part, i - 1) == F.get(part, i - 2), F.lit(False))),
                lambda begins: _let(F.transform(begins, lambda i: F.get(part, i - 1)), lambda present: pick(present, begins)),
            ),
        )

    def signature(t: Column) -> Column:
        zeros = F.array(*[F.lit(0).cast("long")] * m)
        return F.when(F.size(t) == 0, zeros).otherwise(_let(kmers(t), lambda s: _let(elements(s), slots)))

    return _let(tokens, signature)


def _numbered(packed: Column, occurrence: Column) -> Column:
    """A k-mer's later occurrence as an element; the first is the k-mer itself."""
    h = F.xxhash64(packed.bitwiseAND(F.lit(_HASH)), occurrence)
    return h.bitwiseAND(F.lit(_HASH)).bitwiseOR(packed.bitwiseAND(F.lit(_PLACE)))


def _ranking(j: int, shift: int):
    """An element as function ``j`` ranks it: its own part first, the others mixed."""

    def ranked(x: Column) -> Column:
        mixed = F.xxhash64(x.bitwiseAND(F.lit(_HASH)), F.lit(j)).bitwiseAND(F.lit(_HASH)).bitwiseOR(x.bitwiseAND(F.lit(_PLACE)))
        return F.when(F.shiftright(x, shift) == j, x.bitwiseOR(F.lit(_FIRST))).otherwise(mixed)

    return ranked


def _slot(chosen: Column, l: int) -> Column:  # noqa: E741
    """Hash of the chosen elements, in text order."""
    bits = F.lit((1 << (63 - PLACE_BITS)) - 1)
    if l == 2:  # a sort of two is one comparison

        def pair(x: Column) -> Column:
            a, b = F.get(x, 0), F.get(x, 1)
            ha, hb = F.shiftright(a, PLACE_BITS).bitwiseAND(bits), F.shiftright(b, PLACE_BITS).bitwiseAND(bits)
            forward = F.coalesce(a.bitwiseAND(F.lit(_PLACE)) <= b.bitwiseAND(F.lit(_PLACE)), F.lit(True))
            return F.when(forward, F.xxhash64(ha, hb)).otherwise(F.xxhash64(hb, ha))

        # the outer hash has a fixed type, which Spark asks for at every call
        return F.xxhash64(_let(chosen, pair))
    # place first, so that sorting restores the order in the text
    placed = F.transform(
        chosen,
        lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), 63 - PLACE_BITS).bitwiseOR(F.shiftright(x, PLACE_BITS).bitwiseAND(bits)),
    )
    return F.xxhash64(F.transform(F.sort_array(placed), lambda x: x.bitwiseAND(bits)))


def to_string(signature: Column) -> Column:
    """Signature as 8 hex digits per slot."""
    return F.array_join(
        F.transform(signature, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots of two fingerprint strings, 0 to 1."""
    m = (F.length(a) / 8).cast("int")
    same = F.aggregate(
        F.sequence(F.lit(0), m - 1),
        F.lit(0),
        lambda n, i: n + (F.substr(a, i * 8 + 1, F.lit(8)) == F.substr(b, i * 8 + 1, F.lit(8))).cast("int"),
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(same / m).cast("double")


def fingerprint(docs: DataFrame, text: str = "text", m: int = M, k: int = K, l: int = L) -> DataFrame:  # noqa: E741
    """``docs`` with a ``fingerprint`` column; every other column is kept.

    Null and empty texts get the fingerprint of zeros.
    """
    return docs.withColumn("fingerprint", to_string(order_minhash(F.col(text), m, k, l)))


def with_next(docs: DataFrame, order: str, columns: list[str], derive=None, partitions: int | None = None) -> DataFrame:
    """Add ``next_<column>`` of the row that follows in ``order``, cyclically.

    ``derive`` adds costly columns to a table; it is applied to all rows once
    and to the first rows of ranges, not while those are being looked for.

    Rows are cut into ranges of ``order`` at approximate quantiles; within a
    range a window finds the next row, and the last row of a range gets the
    first of the next range that has rows.  Only those first rows, one for each
    range, meet in one task.  Null comes first; ties go by the other columns.
    """
    spark = docs.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    # the number of cuts below a value, by halving
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(cuts).bit_length())))])
    below = F.aggregate(steps, F.lit(0), lambda lo, s: lo + F.when(F.get(edges, lo + s - 1) < F.col(order), s).otherwise(0))
    derive = derive or (lambda df: df)
    plain = docs.withColumn("_range", F.when(F.col(order).isNull(), F.lit(0)).otherwise(below))
    keys = [F.col(order).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in columns]]
    w = Window.partitionBy("_range").orderBy(*keys)
    ranged = derive(plain)
    follow = [c for c in ranged.columns if c not in (order, "_range")]
    inside = ranged.withColumn("_next", F.lead(F.struct(*follow)).over(w))
    first = plain.groupBy("_range").agg(F.min_by(F.struct(*columns), F.struct(F.col(order).isNotNull(), F.col(order), *columns)).alias("_row"))
    heads = derive(first.select("_range", "_row.*"))
    # one row for each range, so n at most
    ring = heads.select(
        F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.lit(-1)).alias("_range"), F.struct(*follow).alias("_head")
    )
    last = heads.agg(F.max("_range").alias("_last"))
    ring = ring.crossJoin(F.broadcast(last)).select(
        F.when(F.col("_range") < 0, F.col("_last")).otherwise(F.col("_range")).alias("_range"), "_head"
    )
    joined = inside.join(F.broadcast(ring), "_range", "left")
    nxt = F.coalesce(F.col("_next"), F.col("_head"))
    return joined.select("*", *[nxt[c].alias(f"next_{c}") for c in follow]).drop("_range", "_next", "_head")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and the text with its last quarter replaced.

    The last ``floor(n_chars / 4)`` code points give way to the first as many
    (or all) of the next text by ``key``.  Only ``key`` and ``text`` are read.
    One row gives itself as its next; an empty table gives no rows.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ahead = with_next(base, "doc_id", ["text"], fingerprint)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.col("next_text"), F.lit(1), cut))
    rows = ahead.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        to_string(order_minhash(F.col("edited"))).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
