"""Vectorised word access for Arrow batches of texts.

The Arrow-based operators share these helpers.  A batch's texts are seen as one
array of UTF-8 bytes plus offsets, so splitting into words and hashing them are
a handful of numpy passes, without a Python object per word.

Nulls count as empty texts everywhere in this module.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; one longer text is handled alone.
CHUNK_BYTES = (1 << 20) - 2

_U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, xor); a bijection on uint64."""
    with np.errstate(over="ignore"):
        x = x.astype(_U64, copy=True)
        x ^= x >> _U64(30)
        x *= _U64(0xBF58476D1CE4E5B9)
        x ^= x >> _U64(27)
        x *= _U64(0x94D049BB133111EB)
        x ^= x >> _U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)
        return mix64(base + mix64(np.array([salt], dtype=_U64))[0])


_STEP = _U64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_STEP_INV = _U64(pow(int(_STEP), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash step and of its inverse; kept while small."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()  # one size is in use but for very long texts
        with np.errstate(over="ignore"):
            up = np.full(size, _STEP, dtype=_U64)
            up[0] = 1
            down = np.full(size, _STEP_INV, dtype=_U64)
            down[0] = 1
            _powers[size] = np.cumprod(up, dtype=_U64), np.cumprod(down, dtype=_U64)
    return _powers[size]


def byte_values(lower: bool = True) -> np.ndarray:
    """Random value of each byte; A-Z share those of a-z when ``lower``."""
    table = seeds(256, 17)
    if lower:
        table[65:91] = table[97:123]
    return table


LOWER = byte_values(True)
EXACT = byte_values(False)

#: Bytes of words split at ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits: 0-9, A-Z, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@dataclass
class Words:
    """Words of a chunk of texts, in order."""

    start: np.ndarray  # byte position
    end: np.ndarray
    doc: np.ndarray  # row of the chunk
    count: np.ndarray  # words of each row
    first: np.ndarray  # index of each row's first word

    def __len__(self) -> int:
        return len(self.start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    if not (large or pa.types.is_string(column.type)):
        column, large = column.cast(pa.large_string()), True
    _, where, data = column.buffers()
    kind = np.int64 if large else np.int32
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that ``column`` has about ``limit`` bytes in each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> Words:
    """Maximal runs of bytes of ``alphabet`` that lie within one row."""
    rows = len(offsets) - 1
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(rows, np.int64), np.zeros(rows, np.int64))
    inside = alphabet[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    return Words(start, end, np.repeat(np.arange(rows), count), count, first[:-1])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial in the step, then a finaliser."""
    if len(start) == 0:
        return np.zeros(0, _U64)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, _U64)
        np.cumsum(values[data] * up[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return mix64(h + (end - start).astype(_U64))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` values that begin at each place (no row edges)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, _U64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, length):
            out = out * _STEP + hashes[i : i + n]
        return mix64(out)


def ngram_rows(w: Words, hashes: np.ndarray, length: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams within rows, and their rows.

    With ``whole``, a row of fewer words, but not none, gives one n-gram: all
    of its words.
    """
    n = len(hashes) - length + 1
    if n > 0:
        keep = w.doc[:n] == w.doc[length - 1 :]
        grams, rows = runs(hashes, length)[keep], w.doc[:n][keep]
    else:
        grams, rows = np.zeros(0, _U64), np.zeros(0, np.int64)
    if whole:
        short = np.flatnonzero((w.count > 0) & (w.count < length))
        if len(short):
            extra = np.empty(len(short), _U64)
            for i, r in enumerate(short):
                a = w.first[r]
                extra[i] = runs(hashes[a : a + w.count[r]], int(w.count[r]))[0]
            grams, rows = np.concatenate([grams, extra]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            grams, rows = grams[order], rows[order]
    return grams, rows


def with_columns(df, text: str, add, fields: list[tuple[str, str]], keep: list[str] | None = None, limit: int = CHUNK_BYTES):
    """``df`` with columns that ``add`` derives from chunks of texts.

    ``add(data, offsets)`` gets a chunk's UTF-8 bytes and row offsets and
    returns an Arrow array for each of ``fields`` (name, SQL type).  ``keep``
    names the columns of ``df`` that pass through (all by default); new names
    take the place of equal ones.  ``limit``: bytes of text in a chunk.
    """
    from pyspark.sql import types as T

    from .scratch import arrow_batches

    arrow_batches(df.sparkSession)
    names = [n for n, _ in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    new = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    fields_in = [T.StructField(f"_{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields_in, *new])
    # columns go by position, so names may clash or hold dots; the text has a position of its own
    source = df.select(*[_quoted(c).alias(f"_{i}") for i, c in enumerate(keep)], _quoted(text).alias("_text"))

    def run(batches):
        for part in chunks(batches, "_text", limit):
            data, offsets = text_bytes(part.column("_text"))
            added = add(data, offsets)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *added], schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *names)


def _quoted(name: str):
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")
