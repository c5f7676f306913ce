"""Language-model scoring with a log-frequency Bloom filter.

The filter holds n-gram counts in logarithmic steps: an n-gram of level q is
inserted as (n-gram, 1) to (n-gram, q), and probed level by level until a miss.
It holds every unigram and bigram of the training texts, so it grows with them.

Bigrams are counted by buckets of their first token, the history; a frequent
history is spread over several.  One task sees a whole bucket, so the bucket's
filter fits the n-grams it has, and the sums over a history's bigrams are known
there.  These sums go along as the history's normalising constants: what the
levels of its bigrams stand for, less the discount, and its share of the
unigram distribution add up to 1.

Runs of buckets are broadcast as blocks of bounded size; a worker reads a
stretch of texts, then probes one block after the other, so it never holds more
than one of them.

Beside the model's score stands an exact smoothed unigram score.  Frequent
tokens' counts, again bounded by a share, go to the workers; the others are
looked up by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches, materialize
from .textbatch import NOT_SPACE, chunks, mix64, span_hashes, text_bytes, words

#: Tokens of at least this share have their exact counts on every worker.
HEAD_SHARE = 1e-6
STEP = 1.4  # ratio of neighbouring levels, where counts are far enough apart
BITS_PER_KEY = 16
DISCOUNT = 0.75
END = np.uint64(0x5EED0E0D0C0B0A09)
_UNIGRAM, _BIGRAM = 1, 2
#: Tokens whose bigrams make up a bucket, about.
BUCKET_TOKENS = 1 << 18
#: A history of more tokens is spread over buckets, unless its share is tiny.
HOT_TOKENS = 1 << 15
#: Bytes of a block of buckets; one larger bucket is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text for which a worker goes through the blocks once.
GROUP_BYTES = 6 << 20
#: Distinct n-grams that a task counts before it passes them on.
HELD = 1 << 19


def _starts() -> np.ndarray:
    """The least count of each level."""
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return np.array(out[:-1], np.int64)


STARTS = _starts()
#: The count that a level stands for: the middle of its range; 0 for level 0.
MEANS = np.concatenate([[0.0], (STARTS + np.append(STARTS[1:], STARTS[-1] + 1) - 1) / 2])
TOP = len(STARTS)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Level of each count, from 1; 0 for no occurrence."""
    return np.searchsorted(STARTS, counts, side="right")


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each row's words, and their rows."""
    w = words(data, offsets, NOT_SPACE)
    rows = len(offsets) - 1
    out = np.full(len(w) + rows, END, np.uint64)
    out[np.arange(len(w)) + w.doc] = span_hashes(data, w.start, w.end)
    return out, np.repeat(np.arange(rows), w.count + 1)


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _entry(grams: np.ndarray, kind: int, level) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(grams + np.uint64(kind << 8) * np.uint64(0xD6E8FEB86659FD93) + np.asarray(level, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _spots(entry: np.ndarray, size) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two words of a bucket of ``size`` words, and four bits in each."""
    out = []
    for salt in (1, 2):
        h = mix64(entry ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        bits = np.zeros(len(h), np.uint64)
        for i in range(4):
            bits |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
        out.append(((h >> np.uint64(24)).astype(np.int64) % size, bits))
    return out


def _in(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values, at


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and where each value is among them; lean in memory."""
    order = np.argsort(values)
    values = values[order]
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return values[new], place


@dataclass
class Deal:
    """Which bucket an n-gram is in."""

    buckets: int
    hot: np.ndarray  # sorted hashes of histories that are spread
    parts: np.ndarray  # over so many buckets
    count: np.ndarray  # their exact counts
    bits: int  # of the filter for each key

    def bucket(self, history: np.ndarray, gram: np.ndarray | None = None) -> np.ndarray:
        """Of bigrams; without ``gram`` of unigrams, which aren't hot."""
        sub = np.zeros(len(history), np.uint64)
        if gram is not None:
            hot, at = _in(history, self.hot)
            sub[hot] = gram[hot] % self.parts[at[hot]].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            return (mix64(history + sub * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(self.buckets)).astype(np.int64)


@dataclass
class Block:
    """Consecutive buckets: their filters' words and their histories."""

    first: int
    start: np.ndarray  # of each bucket's words, and the end of the last
    words: np.ndarray  # and one more, so that an empty bucket can be asked
    history: np.ndarray  # sorted
    total: np.ndarray  # what the levels of a history's bigrams stand for, summed
    share: np.ndarray  # a history's share of the unigram distribution


@dataclass
class Model:
    blocks: list  # broadcasts of Block
    ends: list[int]  # the bucket after each block
    deal: Deal
    hot_total: np.ndarray
    hot_share: np.ndarray
    tokens: int
    types: int
    mass: float  # what the levels of all unigrams stand for, summed

    def probe(self, asks: list[tuple[np.ndarray, np.ndarray, int]], history: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Levels of (buckets, n-grams, kind), 0 where one isn't there; totals and shares of histories."""
        out = [np.zeros(len(grams), np.int64) for _, grams, _ in asks]
        total, share = np.zeros(len(history)), np.ones(len(history))
        homes = self.deal.bucket(history)
        hot, at = _in(history, self.deal.hot)
        total[hot], share[hot] = self.hot_total[at[hot]], self.hot_share[at[hot]]
        begin = 0
        for end, block in zip(self.ends, self.blocks, strict=True):
            held = block.value
            block.__dict__.pop("_value", None)  # or the worker would keep every block
            for (buckets, grams, kind), found in zip(asks, out, strict=True):
                left = np.flatnonzero((buckets >= begin) & (buckets < end))
                for level in range(1, TOP + 1):
                    if not len(left):
                        break
                    start = held.start[buckets[left] - begin]
                    size = held.start[buckets[left] - begin + 1] - start
                    ok = size > 0
                    size = np.maximum(size, 1)
                    for place, bits in _spots(_entry(grams[left], kind, level), size):
                        ok &= (held.words[start + place] & bits) == bits
                    left = left[ok]
                    found[left] = level
            here = np.flatnonzero((homes >= begin) & (homes < end) & ~hot)
            known, at = _in(history[here], held.history)
            total[here[known]], share[here[known]] = held.total[at[known]], held.share[at[known]]
            begin = end
        return out, total, share

    def log10(self, tokens: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the one before it.

        Before the first stands an end.
        """
        known, place = _distinct(np.append(tokens, END))
        pairs = np.append(place[-1:], place[:-2]).astype(np.int64) * len(known) + place[:-1]
        del place
        both, which = _distinct(pairs)
        del pairs
        first, second = (both // len(known)).astype(np.int32), (both % len(known)).astype(np.int32)
        del both
        grams = pair(known[first], known[second])
        hot, where = _in(known, self.deal.hot)
        (level, q), total, share = self.probe([(self.deal.bucket(known), known, _UNIGRAM), (self.deal.bucket(known[first], grams), grams, _BIGRAM)], known)
        level[hot] = level_of(self.deal.count[where[hot]])
        base = self.tokens + 0.5
        p1 = np.where(level > 0, MEANS[level] / max(self.mass, 1.0) * (self.tokens / base), 0.5 / base)
        hit = (q > 0) & (level[first] > 0) & (level[second] > 0) & (total[first] > 0)
        seen = np.zeros(len(q))
        seen[hit] = (MEANS[q[hit]] - DISCOUNT) / total[first[hit]]
        # a probe that errs may tell more than the whole
        return np.log10(np.minimum(seen + share[first] * p1[second], 1.0))[which]


def _merge(held: list[tuple]) -> tuple:
    keys, first, inverse = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate([h[-1] for h in held])).astype(np.int64)
    return (keys, *(np.concatenate([h[i] for h in held])[first] for i in range(1, len(held[0]) - 1)), n)


def _counted(batches, tokens_of, limit: int):
    """Counts of one task's n-grams, merged whenever they pile up.

    An n-gram comes once for each ``limit`` that the task passes on.
    """
    held: list[tuple] = []
    for part in chunks(batches, "text"):
        held.append(_merge([tokens_of(*text_bytes(part.column("text")))]))
        if len(held) >= 16 or sum(len(h[0]) for h in held) >= limit:
            held = [_merge(held)]
            if len(held[0][0]) >= limit // 2:
                yield held.pop()
    if held:
        yield _merge(held)


def _packed(deal: Deal, grams: np.ndarray, history: np.ndarray, n: np.ndarray):
    """A task's bigrams, as one record for each bucket: (bucket, histories, bigrams of each, bigrams, counts)."""
    bucket = deal.bucket(history, grams)
    order = np.lexsort((history, bucket))
    bucket, grams, history, n = bucket[order], grams[order], history[order], n[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=deal.buckets))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        h = history[a:b]
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        own = n[a:b]
        # small counts take a byte
        kind = np.uint8 if own.max() < 256 else np.int64
        yield int(bucket[a]), h[heads].tobytes(), np.diff(np.append(heads, b - a)).astype(np.uint32).tobytes(), grams[a:b].tobytes(), own.astype(kind).tobytes()


_PACKED = "bucket int, histories binary, each binary, grams binary, counts binary"


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of one bucket, their histories and counts, merged."""
    parts = []
    for r in rows:
        grams = np.frombuffer(r["grams"], np.uint64)
        kind = np.uint8 if len(r["counts"]) == len(grams) else np.int64
        history = np.repeat(np.frombuffer(r["histories"], np.uint64), np.frombuffer(r["each"], np.uint32))
        parts.append((grams, history, np.frombuffer(r["counts"], kind).astype(np.int64)))
    return _merge(parts)


def _filter(size: int, entries: list[tuple[np.ndarray, int, np.ndarray]]) -> np.ndarray:
    """A bucket's words, from (n-grams, kind, levels)."""
    held = np.zeros(size, np.uint64)
    for grams, kind, q in entries:
        each = np.repeat(np.arange(len(grams)), q)
        level = np.arange(len(each)) - np.repeat(np.cumsum(q) - q, q) + 1
        for at, bits in _spots(_entry(grams[each], kind, level), size):
            np.bitwise_or.at(held, at, bits)
    return held


_BUILT = "bucket int, size int, words binary, histories binary, totals binary, shares binary, hot binary, hot_totals binary, hot_types binary, mass double"


def _built(deal: Deal, bucket: int, rows: list[dict]) -> tuple:
    grams, owner, n = _unpacked(rows)
    q = level_of(n)
    history, inverse = np.unique(owner, return_inverse=True)
    total, followers = np.bincount(inverse, weights=MEANS[q]), np.bincount(inverse)
    hot, _ = _in(history, deal.hot)
    own = ~hot
    # a token is the history of as many tokens as it occurs
    level = level_of(np.bincount(inverse, weights=n).astype(np.int64)[own])
    size = int(-(-(int(q.sum()) + int(level.sum())) * deal.bits // 64))
    filled = _filter(size, [(grams, _BIGRAM, q), (history[own], _UNIGRAM, level)])
    share = DISCOUNT * followers / total
    return (
        bucket, size, filled.tobytes(),
        history[own].tobytes(), total[own].astype(np.float32).tobytes(), share[own].astype(np.float32).tobytes(),
        history[hot].tobytes(), total[hot].tobytes(), followers[hot].astype(np.int64).tobytes(), float(MEANS[level].sum()),
    )


def _by_bucket(batches):
    """Buckets with their rows; rows come sorted by bucket."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != last and held:
                yield last, held
                held = []
            last = row["bucket"]
            held.append(row)
    if held:
        yield last, held


def _records(rows, schema: str, count: int):
    """Record batches of at most ``count`` rows."""
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) == count:
            yield batch()
            held = []
    if held:
        yield batch()


def train(docs: DataFrame, text: str = "text", bits: int = BITS_PER_KEY, held: int = HELD) -> tuple[Model, DataFrame]:
    """Learn from all rows; returns the model and the table of all counts.

    The table has ``h`` (a token's hash) and ``n``.  Null texts count as empty;
    no rows give a model without n-grams.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    source = docs.select(F.col(text).alias("text"))

    def unigrams(batches):
        def one(data, offsets):
            tokens, _ = sequence(data, offsets)
            return tokens, np.ones(len(tokens), np.int64)

        for h, n in _counted(batches, one, held):
            for a in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 200_000].view(np.int64)), pa.array(n[a : a + 200_000])], ["h", "n"])

    counts = materialize(source.mapInArrow(unigrams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    sums = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).first()
    tokens, types = int(sums["tokens"] or 0), int(sums["types"])
    hot_from = max(HOT_TOKENS, int(np.ceil(HEAD_SHARE * tokens)))
    hot = counts.filter(F.col("n") >= hot_from).toArrow()  # at most 1 / HEAD_SHARE rows
    order = np.argsort(hot["h"].to_numpy().view(np.uint64))
    hot_h, hot_n = hot["h"].to_numpy().view(np.uint64)[order], hot["n"].to_numpy()[order]
    deal = Deal(1 << int(np.ceil(np.log2(max(4, tokens / max(BUCKET_TOKENS, hot_from))))), hot_h, -(-hot_n // hot_from), hot_n, bits)
    shared = spark.sparkContext.broadcast(deal)

    def bigrams(batches):
        def two(data, offsets):
            seq, _ = sequence(data, offsets)
            before = np.concatenate([[END], seq[:-1]])[: len(seq)]
            return pair(before, seq), before, np.ones(len(seq), np.int64)

        for grams, history, n in _counted(batches, two, held):
            yield from _records(_packed(shared.value, grams, history, n), _PACKED, 1 << 12)

    def build(batches):
        yield from _records((_built(shared.value, bucket, rows) for bucket, rows in _by_bucket(batches)), _BUILT, 1)

    packed = source.mapInArrow(bigrams, _PACKED).repartition("bucket").sortWithinPartitions("bucket")
    built = materialize(packed.mapInArrow(build, _BUILT))
    mass = float(built.agg(F.sum("mass")).first()[0] or 0.0) + float(MEANS[level_of(hot_n)].sum())
    # a hot history has a row for each of its buckets, at most 2 / HEAD_SHARE in all
    spread = built.filter(F.length("hot") > 0).select("hot", "hot_totals", "hot_types").toArrow()
    hot_total, hot_types = np.zeros(len(hot_h)), np.zeros(len(hot_h))
    for h, t, k in zip(*(spread[c].to_pylist() for c in ("hot", "hot_totals", "hot_types")), strict=True):
        _, at = _in(np.frombuffer(h, np.uint64), hot_h)
        np.add.at(hot_total, at, np.frombuffer(t, np.float64))
        np.add.at(hot_types, at, np.frombuffer(k, np.int64))
    blocks, ends = _broadcast(built, deal.buckets)
    return Model(blocks, ends, deal, hot_total, DISCOUNT * hot_types / np.maximum(hot_total, 1.0), tokens, types, mass), counts


def _broadcast(built: DataFrame, buckets: int) -> tuple[list, list[int]]:
    """Broadcasts of consecutive buckets, and the bucket after each."""
    spark = built.sparkSession
    sizes = built.select("bucket", (F.length("words") + 2 * F.length("histories")).alias("bytes")).toArrow()  # a row for each bucket
    weight = np.zeros(buckets, np.int64)
    weight[sizes["bucket"].to_numpy()] = sizes["bytes"].to_numpy()
    ends, held = [], 0
    for b in range(buckets):
        if held and held + weight[b] > BLOCK_BYTES:
            ends.append(b)
            held = 0
        held += int(weight[b])
    ends.append(buckets)
    blocks, begin = [], 0
    for end in ends:
        rows = built.filter((F.col("bucket") >= begin) & (F.col("bucket") < end)).drop("hot", "hot_totals", "hot_types", "mass").toArrow()  # one block: bounded
        where = rows["bucket"].to_numpy() - begin
        size = np.zeros(end - begin, np.int64)
        size[where] = rows["size"].to_numpy()
        start = np.concatenate([[0], np.cumsum(size)])
        filled = np.zeros(start[-1] + 1, np.uint64)
        for b, x in zip(where.tolist(), rows["words"], strict=True):
            filled[start[b] : start[b + 1]] = np.frombuffer(x.as_buffer(), np.uint64)
        history, total, share = (np.concatenate([np.zeros(0, k), *(np.frombuffer(x.as_buffer(), k) for x in rows[c])]) for c, k in (("histories", np.uint64), ("totals", np.float32), ("shares", np.float32)))
        del rows
        pa.default_memory_pool().release_unused()
        order = np.argsort(history)
        block = Block(begin, start, filled, history[order], total[order], share[order])
        blocks.append(spark.sparkContext.broadcast(block))
        begin = end
    return blocks, ends


def _grouped(parts, limit: int):
    """Lists of consecutive parts of about ``limit`` bytes of text."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.column("text").nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scored(batches, model: Model, group_bytes: int):
    """Parts with their tokens, the tokens' rows and log10 probabilities."""
    for group in _grouped(chunks(batches, "text"), group_bytes):
        read = [sequence(*text_bytes(part.column("text"))) for part in group]
        docs = [doc.astype(np.int32) for _, doc in read]
        # each part ends with an end, so they follow each other as rows do
        tokens = np.concatenate([seq for seq, _ in read])
        del read
        logs = model.log10(tokens)
        last = 0
        for part, doc in zip(group, docs, strict=True):
            to = last + len(doc)
            yield part, tokens[last:to], doc, logs[last:to]
            last = to


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Score every row by the model and by exact smoothed unigram counts.

    Returns ``keep`` (all columns by default; equal names give way) and
    ``n_tokens, n_known, train_tokens, base_score, score``.  Null counts as
    empty; an empty text is one token, its end.  Repeated rows are scored each.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    tokens, types = model.tokens, model.types
    scale = tokens + 0.5 * (types + 1)
    # at most 1 / HEAD_SHARE tokens
    head = counts.filter(F.col("n") >= max(1, int(np.ceil(HEAD_SHARE * tokens)))).toArrow()
    order = np.argsort(head["h"].to_numpy().view(np.uint64))
    head_h, head_n = head["h"].to_numpy().view(np.uint64)[order], head["n"].to_numpy()[order]
    shared = spark.sparkContext.broadcast((head_h, head_n))
    group_bytes = GROUP_BYTES
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).alias("text"))
    row_type = source.schema["row"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        head_h, head_n = shared.value
        number = TaskContext.get().partitionId() << 40  # of rows, task by task
        for part, seq, doc, logs in _scored(batches, model, group_bytes):
            rows = part.num_rows
            known, place = np.unique(seq, return_inverse=True)
            frequent, at = _in(known, head_h)
            base = np.zeros(len(known))
            base[frequent] = np.log10((head_n[at[frequent]] + 0.5) / scale)
            own = frequent[place]
            pairs, times = np.unique(doc[~own].astype(np.int64) * len(known) + place[~own], return_counts=True)
            asks = len(pairs)
            add = lambda x: np.bincount(doc, weights=x, minlength=rows)
            ids = number + np.arange(rows)
            number += rows
            # a row for each text, under a key that no token has, then what it asks for
            none = pa.nulls(asks, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids, ids[pairs // len(known)]])),
                    pa.array(np.concatenate([mix64(ids.astype(np.uint64)), known[pairs % len(known)]]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(rows, np.int64), times])),
                    pa.concat_arrays([part.column("row"), pa.nulls(asks, part.column("row").type)]),
                    pa.concat_arrays([pa.array(np.bincount(doc, minlength=rows).astype(np.int64)), pa.nulls(asks, pa.int64())]),
                    pa.concat_arrays([pa.array(add(own.astype(float)).astype(np.int64)), pa.nulls(asks, pa.int64())]),
                    pa.concat_arrays([pa.array(add(base[place])), none]),
                    pa.concat_arrays([pa.array(add(logs)), none]),
                ],
                ["id", "h", "times", "row", "n_tokens", "head", "base", "score"],
            )

    asked = source.mapInArrow(run, f"id long, h long, times long, row {row_type}, n_tokens long, head long, base double, score double")
    found = asked.join(counts, "h", "left")
    part = F.when(F.col("times") > 0, F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(scale)))
    sums = found.groupBy("id").agg(
        F.first("row", ignorenulls=True).alias("row"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("head") + F.coalesce(F.sum(F.when((F.col("times") > 0) & (F.col("n") > 0), F.col("times"))), F.lit(0))).cast("long").alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(part), F.lit(0.0))).alias("base_score"),
        F.max("score").alias("score"),
    )
    return sums.select(*[F.col("row")[c].alias(c) for c in keep], "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(key: str = "doc_id"):
    """Rows kept from training: crc32 of the key's text, modulo 5, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def score_held_out(docs: DataFrame, **options) -> DataFrame:
    """Train on the rows not held out and score all.

    A row for each document, repeats included.  Null texts count as empty: they
    have one token, the end.  A null key isn't held out.  Without training rows
    no token is known.
    """
    model, counts = train(docs.filter(~held_out()).select("text"), **options)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, counts, keep=["doc_id", "held_out"])
