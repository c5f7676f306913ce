"""Language identification by bit-sliced Bloom filters of n-grams.

A filter's slot holds one bit for each language.  An n-gram's slots, anded,
name all languages that (appear to) contain it, in one look-up for all of them.
A text's languages are counted over its n-grams; a language's count is
corrected for its filter's share of false positives; the largest count wins.

A language contains every n-gram of its training texts, of which there are
about ``TRAIN_DOCS``: that, not the corpus, bounds what is gathered and
broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches
from .textbatch import chunks, mix64, text_bytes, with_columns

N = 4  # bytes of an n-gram; white space and the like only at its ends
#: Least share of a language's n-grams that one must have to count as contained: every one does.
MIN_SHARE = 0.0
#: About so many training documents of each language, chosen by hash of the key.
TRAIN_DOCS = 20_000
#: Slots of a filter for each n-gram of the largest language, at least.
SLOTS_PER_GRAM = 16
PROBES = 2
UNDETERMINED = "und"
#: Of texts with letters, where nothing was learned.
UNKNOWN = "unknown"

# letters as they are in lower case, everything else in ASCII a blank
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte n-grams of words, blanks around them included, and their rows."""
    rows = len(offsets) - 1
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    # a blank before and after each row, so no n-gram spans two rows
    padded = np.full(len(data) + 2 * rows, 0x20, np.uint8)
    padded[np.arange(len(data)) + 2 * doc + 1] = _FOLD[data]
    if len(padded) < N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    inner = (padded[1:-2] != 0x20) & (padded[2:-1] != 0x20)
    at = np.flatnonzero(inner)
    gram = padded[at].astype(np.uint32)
    for i in range(1, N):
        gram |= padded[at + i].astype(np.uint32) << np.uint32(8 * i)
    return gram, np.searchsorted(offsets + 2 * np.arange(rows + 1), at + 1, side="right") - 1


@dataclass
class Filter:
    """Bit-sliced Bloom filter: ``slots[probe][place]`` is a mask of languages."""

    languages: list[str]
    slots: list[np.ndarray]  # for each plane of 64 languages: (probes, size)
    false_share: np.ndarray  # for each language
    fallback: int  # the most frequent language

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each plane, the languages that contain each n-gram."""
        out = []
        h = mix64(grams)
        for plane in self.slots:
            size = np.uint64(plane.shape[1] - 1)
            mask = plane[0][(h & size).astype(np.int64)]
            for k in range(1, PROBES):
                mask = mask & plane[k][(h >> np.uint64(64 // PROBES * k) & size).astype(np.int64)]
            out.append(mask)
        return out


def _smallest_type(languages: int):
    return next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(languages, 64) <= n)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS, least_share: float = MIN_SHARE) -> Filter:
    """Learn the filter from rows with a language; null languages are left out.

    No rows to learn from give a filter without languages, to which every text
    with a letter is ``unknown``.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    totals = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filter([], [], np.zeros(0), 0)
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, per_language / totals[name])))])
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / float(1 << 20)
    number = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    sample = rows.filter(draw < share[F.col("l")]).select(number[F.col("l")].alias("l"), "t")

    def count(batches):
        # one task's counts, merged when they pile up
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for part in chunks(batches, "t"):
            data, offsets = text_bytes(part.column("t"))
            gram, row = ngrams(data, offsets)
            l = part.column("l").to_numpy().astype(np.int64)  # noqa: E741
            held.append(np.unique(l[row] << 32 | gram.astype(np.int64), return_counts=True))
            if len(held) >= 16:
                held = [merged()]
        if held:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], ["l", "g", "n"])

    grams = sample.mapInArrow(count, "l long, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    if least_share > 0:
        grams = grams.join(F.broadcast(grams.groupBy("l").agg(F.sum("n").alias("all"))), "l").filter(F.col("n") >= F.lit(least_share) * F.col("all"))
    kept = grams.groupBy("g").agg(F.collect_set("l").alias("ls")).toArrow()
    g = kept["g"].to_numpy().astype(np.uint32)
    lists = kept["ls"].combine_chunks()
    owner = np.repeat(np.arange(len(g)), np.diff(lists.offsets.to_numpy())) if len(g) else np.zeros(0, np.int64)
    member = lists.flatten().to_numpy().astype(np.int64) if len(g) else np.zeros(0, np.int64)
    most = int(np.bincount(member).max()) if len(member) else 1
    size = 1 << int(np.ceil(np.log2(max(1 << 12, most * SLOTS_PER_GRAM))))
    h = mix64(g)
    planes, fills = [], np.ones(len(languages))
    for first in range(0, len(languages), 64):
        kind = _smallest_type(len(languages) - first)
        plane = np.zeros((PROBES, size), kind)
        here = (member >= first) & (member < first + 64)
        bits = (np.ones(1, np.uint64) << (member[here] - first).astype(np.uint64)).astype(kind)
        for k in range(PROBES):
            place = (h >> np.uint64(64 // PROBES * k if k else 0) & np.uint64(size - 1)).astype(np.int64)
            np.bitwise_or.at(plane[k], place[owner[here]], bits)
            for i in range(first, min(first + 64, len(languages))):
                fills[i] *= float(np.mean(plane[k] >> kind(i - first) & kind(1)))
        planes.append(plane)
    return Filter(languages, planes, fills, max(range(len(languages)), key=lambda i: (totals[languages[i]], -i)))


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    fold = _FOLD[data]
    ascii_letter = (fold >= 0x61) & (fold <= 0x7A)
    edge = offsets[:-1]
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    out = count(ascii_letter) > 0
    for r in np.flatnonzero(~out & (count(data >= 0x80) > 0)):
        out[r] = any(c.isalpha() for c in data[edge[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _judge(f: Filter, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    rows = len(offsets) - 1
    letters = _has_letter(data, offsets)
    if not f.languages:
        return [pa.array(np.where(letters, UNKNOWN, UNDETERMINED).tolist(), pa.string()), pa.array(np.zeros(rows))]
    gram, row = ngrams(data, offsets)
    count = np.zeros((rows, len(f.languages)))
    for plane, mask in enumerate(f.masks(gram)):
        span = f.languages[64 * plane : 64 * plane + 64]
        if mask.dtype == np.uint8:
            by_mask = np.bincount(row * 256 + mask, minlength=rows * 256).reshape(rows, 256)
            bits = (np.arange(256)[:, None] >> np.arange(len(span))) & 1
            count[:, 64 * plane : 64 * plane + len(span)] = by_mask @ bits
        else:
            for i in range(len(span)):
                count[:, 64 * plane + i] = np.bincount(row, weights=(mask >> mask.dtype.type(i)) & mask.dtype.type(1), minlength=rows)
    n = np.bincount(row, minlength=rows)[:, None]
    # expected count = true + false_share * (n - true)
    true = np.clip((count - n * f.false_share) / np.maximum(1 - f.false_share, 1e-9), 0, None)
    best = true.argmax(1)
    best[true.max(1) == 0] = f.fallback
    score = np.divide(true[np.arange(rows), best], true.sum(1), out=np.zeros(rows), where=true.sum(1) > 0)
    names = np.array(f.languages, dtype=object)[best]
    names[~letters] = UNDETERMINED
    score[~letters] = 0.0
    return [pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))]


def identify(docs: DataFrame, model: Filter, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``.

    A null text, or one without a letter, is ``und`` with score 0.  Equal
    counts go to the first language by name; a text with letters of which no
    language has an n-gram gets the most frequent language with score 0.  The
    score is the winner's share of all languages' corrected counts.  New
    columns take the place of equal names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs, text, lambda data, offsets: _judge(shared.value, data, offsets), [("lang_pred", "string"), ("lang_score", "double")], keep)


def held_out(key: str = "doc_id"):
    """Rows kept from training: crc32 of the key's text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """Train on the rows not held out and predict all.

    Returns ``doc_id, held_out, lang_pred, score``, a row for each document,
    repeats included.  Null languages teach nothing; a null key isn't held out;
    null texts and texts without a letter are ``und`` with score 0.
    """
    model = train(docs.filter(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    out = identify(rows, model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
