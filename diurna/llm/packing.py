"""Best-fit packing of tokenised documents into sequences.

Lengths are whole numbers of at most the capacity, so a histogram of lengths
describes any number of pieces.  The plan is made on that histogram: pieces of
more than a third of the capacity are matched greedily, two in a sequence at
most; smaller ones fill the gaps, the tightest first.  The plan says which
sequences the pieces of a length get by rank; pieces are ranked and placed in
parallel.  The histogram has one row for each length, the plan a few for each
pair of lengths, whatever the number of documents.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import arrow_batches, materialize
from .textbatch import chunks, mix64, seeds, text_bytes

CAPACITY = 1024
END_ID = 2
#: Buckets in which the pieces of one length are ranked.
RANK_BUCKETS = 256
#: Distinct words whose ids a worker keeps; it starts afresh beyond.
CACHE_WORDS = 1 << 19
_CHUNK = (1 << 20) - 2

_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    """Class of each code point for the byte-level pre-tokeniser."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _DIGIT
        elif kind == "C":  # perhaps a letter in a later Unicode: ask the tokenizer
            table[c] = _UNKNOWN
    for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = _SPACE
    return table


#: Endings that split off after an apostrophe (a fixed value of the vocabulary).
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def split_words(points: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's words begin in rows of code points.

    The rule, in order: an apostrophe and one of a few endings; letters, digits
    or others with one blank before; white space up to the last before a word;
    white space.
    """
    n = len(points)
    kind = table[points]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    first = np.zeros(n, bool)
    first[edges[edges < n]] = True
    last = np.zeros(n, bool)
    last[:-1] = first[1:]
    last[-1] = True
    space = kind == _SPACE
    change = first | (kind != before)
    # a word begins at a change of class, unless a blank before it joins it
    joined = np.zeros(n, bool)
    joined[1:] = (points[:-1] == 0x20) & ~space[1:] & ~first[1:]
    begin = change & ~joined
    # the last white space before a word stands alone or joins it
    following = np.zeros(n, bool)
    following[:-1] = ~space[1:] & ~last[:-1]
    begin |= space & following
    # an apostrophe that begins a word of its own class and is followed by letters
    quote = np.flatnonzero((points == 0x27) & begin)
    for suffix in _SUFFIXES if len(quote) else ():
        m = len(suffix)
        q = quote[quote + m < n]
        ok = np.ones(len(q), bool)
        for i, c in enumerate(suffix):
            ok &= (points[q + 1 + i] == ord(c)) & ~first[q + 1 + i]
        q = q[ok]
        begin[q + 1] = False
        after = q + 1 + m
        inside = after[after < n]
        begin[inside[(kind[inside] == _LETTER) & ~first[inside]]] = True
    return np.flatnonzero(begin)


@dataclass
class WordIds:
    """Token ids of words: each distinct word is encoded once and kept.

    ``path`` names a vocabulary of the tokenizers library.
    """

    path: str
    ready: bool = False
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))

    def _open(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.table = _classes()
        self.values = seeds(1 << 16, 3)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ready = True

    def _settle(self, points: np.ndarray) -> None:
        """Class of code points that Python's Unicode tables don't have."""
        pre = self.tokenizer.pre_tokenizer
        for c in np.unique(points[self.table[points] == _UNKNOWN]).tolist():
            with_same = [len(pre.pre_tokenize_str(x + chr(c))) == 1 for x in "a1!"]
            self.table[c] = (_LETTER, _DIGIT, _OTHER)[with_same.index(True)] if any(with_same) else _SPACE

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.keys) > CACHE_WORDS:
            self.keys, self.start, self.count, self.ids = (x[:0] for x in (self.keys, self.start, self.count, self.ids))
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(count.sum()))
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, flat])
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.start = np.concatenate([self.start, start.astype(np.uint32)])[order]
        self.count = np.concatenate([self.count, count.astype(np.uint32)])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and each row's number of ids."""
        if not self.ready:
            self._open()
        raw = data.tobytes()
        special = sorted({r for t in self.added if t in raw for r in self._rows_with(t, raw, offsets)})
        if not special:
            return self._encode(data, offsets)
        # texts that name an added token go to the library as they are
        rows = len(offsets) - 1
        parts, counts, last = [], [], 0
        for r in [*special, rows]:
            ids, count = self._encode(data[offsets[last] : offsets[r]], offsets[last : r + 1] - offsets[last])
            parts.append(ids)
            counts.append(count)
            if r < rows:
                own = self.tokenizer.encode(raw[offsets[r] : offsets[r + 1]].decode("utf-8"), add_special_tokens=False).ids
                parts.append(np.array(own, np.uint32))
                counts.append(np.array([len(own)], np.int64))
            last = r + 1
        return np.concatenate(parts), np.concatenate(counts)

    @staticmethod
    def _rows_with(token: bytes, raw: bytes, offsets: np.ndarray):
        at = raw.find(token)
        while at >= 0:
            r = int(np.searchsorted(offsets, at, side="right")) - 1
            inside = at + len(token) <= offsets[r + 1]
            if inside:
                yield r
            at = raw.find(token, int(offsets[r + 1]) if inside else at + 1)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if (self.table[points] == _UNKNOWN).any():
            self._settle(points)
        # code points before each row: bytes that don't continue a character
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        edges = heads[offsets]
        begin = split_words(points, edges[:-1], self.table)
        end = np.append(begin[1:], len(points))
        row = np.searchsorted(edges, begin, side="right") - 1
        hashes = _hashes(points, begin, end, self.values)
        known, inverse = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(self.keys, known)
        new = np.ones(len(known), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != known
        if new.any():
            if len(self.keys) + int(new.sum()) > CACHE_WORDS:
                new[:] = True
                self.keys = self.keys[:0]
                self.start, self.count, self.ids = self.start[:0], self.count[:0], self.ids[:0]
            some = np.empty(len(known), np.int64)
            some[inverse] = np.arange(len(inverse))  # any word with that hash
            pick = some[new]
            self._learn(known[new], [text[a:b] for a, b in zip(begin[pick].tolist(), end[pick].tolist(), strict=True)])
            at = np.searchsorted(self.keys, known)
        count, start = self.count[at][inverse].astype(np.int64), self.start[at][inverse].astype(np.int64)
        total = int(count.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        ids = self.ids[np.repeat(start, count) + inside]
        return ids, np.bincount(row, weights=count, minlength=rows).astype(np.int64)


def _hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    from .textbatch import _power_tables

    up, down = _power_tables(len(points) + 1)
    with np.errstate(over="ignore"):
        value = values[points & np.uint32(0xFFFF)]
        if points.max() > 0xFFFF:
            value = mix64(value + (points >> np.uint32(16)).astype(np.uint64))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value * up[: len(points)], out=total[1:])
        return mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


_CODERS: dict[str, WordIds] = {}


def _coder(vocabulary: str) -> WordIds:
    """One for each worker process and vocabulary, so tasks share what it knows."""
    return _CODERS.setdefault(vocabulary, WordIds(vocabulary))


def tokenize_pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` tokens.

    A document is its text's ids and ``end_id``; null counts as empty, so every
    row has a piece.  Names of added tokens in a text are these tokens, as in
    the tokenizers library.  Of a longer document the first piece holds what is
    over from whole ones.  Returns ``key, piece, start, length, ids_crc32``.
    """
    arrow_batches(docs.sparkSession)
    schema = docs.select(F.col(key)).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1) + ", piece int, start long, length long, ids_crc32 long"

    def run(batches):
        coder = _coder(vocabulary)
        for part in chunks(batches, "_text", _CHUNK):
            ids, count = coder.encode(*text_bytes(part.column("_text")))
            out: list[list[int]] = [[], [], [], [], []]
            at = 0
            for r, n in enumerate(count.tolist()):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                total, start, piece = n + 1, 0, 0
                while start < total:
                    size = (total - start) % capacity or capacity
                    for column, x in zip(out, (r, piece, start, size, zlib.crc32(own[start : start + size].tobytes())), strict=True):
                        column.append(x)
                    start += size
                    piece += 1
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


@dataclass
class Plan:
    """Where the pieces of a length go, by rank.

    Entry e serves ranks ``rank[e]`` and on of ``length[e]``: ``each[e]`` in a
    row fill one sequence, from ``sequence[e]`` on, behind ``offset[e]`` tokens.
    """

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``counts[length]`` pieces of each length.

    Large pieces, above a third of the capacity, come first: the longest left
    is matched with the longest other that fits, two in a sequence at most.
    Then smaller ones, the longest first, go where the least room remains.
    """
    entries: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)  # pieces placed of each length
    #: runs of alike sequences by their room: (first sequence, how many)
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sequences = 0

    def place(length: int, sequence: int, bins: int, offset: int, each: int = 1, pieces: int | None = None) -> None:
        entries.append((length, used[length], sequence, offset, each))
        used[length] += bins * each if pieces is None else pieces

    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be between 1 and the capacity")
    large = [n for n in left if 3 * n > capacity]
    for n in large:
        while left[n]:
            fits = next((x for x in large if left[x] and x <= n and x + n <= capacity and (x != n or left[n] > 1)), None)
            if fits is None:
                bins = left[n]
                place(n, sequences, bins, 0)
                rooms[capacity - n].append((sequences, bins))
                left[n] = 0
            else:
                bins = left[n] // 2 if fits == n else min(left[n], left[fits])
                place(n, sequences, bins, 0)
                left[n] -= bins
                place(fits, sequences, bins, n)
                left[fits] -= bins
                rooms[capacity - n - fits].append((sequences, bins))
            sequences += bins
    for n in (n for n in left if 3 * n <= capacity):
        while left[n]:
            room = min((r for r in rooms if r >= n and rooms[r]), default=None)
            if room is None:
                each = capacity // n
                bins = -(-left[n] // each)
                rooms[capacity].append((sequences, bins))
                sequences += bins
                room = capacity
            first, bins = rooms[room].pop()
            each = room // n
            full = min(bins, left[n] // each)
            if full:
                place(n, first, full, capacity - room, each)
                left[n] -= full * each
                rooms[room - each * n].append((first, full))
            if full < bins:
                rest = left[n]
                if rest and rest < each:  # the last pieces share one sequence
                    place(n, first + full, 1, capacity - room, each, rest)
                    left[n] = 0
                    rooms[room - rest * n].append((first + full, 1))
                    full += 1
                if full < bins:
                    rooms[room].append((first + full, bins - full))
    entries.sort()
    return Plan(*(np.array([e[i] for e in entries], np.int64) for i in (0, 1, 2, 3, 4)), sequences)


def pack(pieces: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``.

    A full piece is a sequence of its own, with a negative number.  The others
    of a length are ranked within hash buckets and shifted by the buckets
    before, so no task sees all pieces of a frequent length.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")))
    full = pieces.filter(F.col("length") == capacity).drop("_bucket").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    pieces = pieces.filter(F.col("length") < capacity)
    sizes = pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    table = sizes.toArrow()  # at most capacity * RANK_BUCKETS rows
    length, bucket, n = (table[c].to_numpy().astype(np.int64) for c in ("length", "_bucket", "_n"))
    order = np.lexsort((bucket, length))
    length, bucket, n = length[order], bucket[order], n[order]
    per = np.bincount(length, weights=n, minlength=capacity + 1).astype(np.int64)
    before = np.cumsum(n) - n - (np.cumsum(per) - per)[length]
    shift = np.zeros((capacity + 1, RANK_BUCKETS), np.int64)
    shift[length, bucket] = before
    made = plan({int(i): int(c) for i, c in enumerate(per) if c}, capacity)
    shared = spark.sparkContext.broadcast((shift, made))
    w = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(w) - 1)
    names = [c for c in pieces.columns if c != "_bucket"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_bucket") + ", sequence_id long, offset long"

    def run(batches):
        shift, p = shared.value
        top = int(p.rank.max()) + 1 if len(p.rank) else 1
        for part in batches:
            length = part.column("length").to_numpy().astype(np.int64)
            rank = part.column("_rank").to_numpy() + shift[length, part.column("_bucket").to_numpy()]
            # entries are sorted by length, then rank
            e = _last_at_most(p.length, p.rank, length, rank, top)
            i = rank - p.rank[e]
            sequence = p.sequence[e] + i // p.each[e]
            offset = p.offset[e] + i % p.each[e] * length
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema).unionByName(full)


def _last_at_most(lengths, ranks, length, rank, top) -> np.ndarray:
    """For each (length, rank) the last entry of that length with a rank at most that."""
    out = np.empty(len(length), np.int64)
    for n in np.unique(length):
        a, b = np.searchsorted(lengths, [n, n + 1])
        own = length == n
        out[own] = a + np.searchsorted(ranks[a:b], rank[own], side="right") - 1
    return out


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row for each piece: ``key, piece, start, length, ids_crc32,
    sequence_id, offset``; a sequence's pieces leave no gap from its offset 0.
    Null and empty texts are one token, the end.  Repeated rows are packed as
    often as they occur.  An empty table gives an empty result.
    """
    out = pack(tokenize_pieces(docs, vocabulary, key, text, capacity, end_id), key, capacity)
    return out.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
