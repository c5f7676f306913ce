"""Fill-in-middle transformation: a text cut twice between units, its parts moved.

Units are lines, words or characters.  A chunk of texts is stored as maximal
runs of bytes of one class (unit marks or others), each with the number of units
before it.  A cut after ``k`` units needs one binary search for the run that
holds the ``k``-th mark, and its offset follows by arithmetic: no text is split
into units.

All choices depend on the row's key alone, so they don't change with
partitioning, and repeated rows get the same form.  Nulls count as empty texts,
a null key as the empty string; a text that is empty or holds a sentinel stays
plain.  Texts of any length are cut whole, each in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import arrow_batches
from .textbatch import NOT_SPACE, _quoted, chunks, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Columns that the transformation adds.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False
#: Byte class whose members mark units; whether each byte counts or each run; whether a mark ends its unit or begins it.
_UNITS = {"line": (_NEWLINE, True, True), "char": (_LEAD, True, False), "word": (NOT_SPACE, False, False)}


@dataclass
class ClassRuns:
    """Maximal runs of one byte class within rows, with cumulative unit counts."""

    start: np.ndarray  # byte position of each run
    before: np.ndarray  # marks before each run, over the whole chunk
    total: int
    offsets: np.ndarray
    base: np.ndarray  # marks before each row
    count: np.ndarray  # units of each row
    each: bool
    ends: bool

    def cut(self, row: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Byte position after ``k`` units of each row (0 to the row's count)."""
        number = self.base[row] + k - (1 if self.ends else 0)  # of the mark that ends unit k, or begins the next
        inner = (k > 0) & (k < self.count[row])
        out = np.where(k > 0, self.offsets[row + 1], self.offsets[row])
        if inner.any():
            number = number[inner]
            run = np.searchsorted(self.before, number, side="right") - 1
            out[inner] = self.start[run] + (number - self.before[run] if self.each else 0) + (1 if self.ends else 0)
        return out


def class_runs(data: np.ndarray, offsets: np.ndarray, unit: str = "line") -> ClassRuns:
    """Run-length encoding of a chunk's bytes by the class that marks ``unit``."""
    marks, each, ends = _UNITS[unit]
    rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return ClassRuns(none, none, 0, offsets, np.zeros(rows, np.int64), np.zeros(rows, np.int64), each, ends)
    inside = marks[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(edge)
    length = np.diff(start, append=len(data))
    units = np.where(inside[start], length if each else 1, 0)
    after = np.cumsum(units)
    before = after - units
    first = np.searchsorted(start, offsets)  # each row's first run
    sums = np.append(before, after[-1])
    base = sums[first]
    count = np.diff(base)
    long = np.diff(offsets) > 0
    if ends:  # what stands after the last mark is a unit too
        count[long] += ~inside[offsets[1:][long] - 1]
    else:  # a text without a mark is one unit
        count = np.where(long, np.maximum(count, 1), 0)
    # only runs of marks are searched: others have no units of their own
    held = units > 0
    return ClassRuns(start[held], before[held], int(after[-1]), offsets, base[:-1], count, each, ends)


def draws(key: Column, seed: int = 7) -> list[Column]:
    """Four unsigned 32-bit numbers of each key, from SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with the fill-in-middle ``output`` of each whole text.

    ``n`` units; ``form`` plain, psm or spm; ``prefix_chars`` and
    ``middle_chars`` in code points, null for plain texts.  ``rate`` percent of
    texts are cut, ``spm`` percent of these in suffix-first order.  New columns
    take the place of equally named ones.  One pass, no shuffle.
    """
    arrow_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ADDED]
    source = docs.select(*[_quoted(c).alias(f"_{i}") for i, c in enumerate(keep)], *[h.alias(f"_h{i}") for i, h in enumerate(draws(_quoted(key), seed))], _quoted(text).alias("_text"))
    new = T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output string")
    schema = T.StructType([*[T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(keep)], *new])

    def run(batches):
        for part in chunks(batches, "_text"):
            data, offsets = text_bytes(part.column("_text"))
            h = [part.column(f"_h{i}").to_numpy() for i in range(4)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *_cut(data, offsets, h, unit, rate, spm)], schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *ADDED)


def _cut(data: np.ndarray, offsets: np.ndarray, h: list[np.ndarray], unit: str, rate: int, spm: int) -> list[pa.Array]:
    runs = class_runs(data, offsets, unit)
    rows = np.arange(len(offsets) - 1)
    one, two = h[0] % (runs.count + 1), h[1] % (runs.count + 1)
    low, high = runs.cut(rows, np.minimum(one, two)), runs.cut(rows, np.maximum(one, two))
    whole = data.tobytes()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LEAD[data], out=lead[1:])
    prefix, middle = lead[low] - lead[offsets[:-1]], lead[high] - lead[low]
    form, output = [], []
    for i in range(len(rows)):
        body = whole[offsets[i] : offsets[i + 1]]
        if not body or h[2][i] % 100 >= rate or any(m in body for m in marks):
            form.append("plain")
            output.append(body)
            continue
        a, b = low[i] - offsets[i], high[i] - offsets[i]
        parts = {PREFIX: body[:a], SUFFIX: body[b:], MIDDLE: body[a:b]}
        form.append("spm" if h[3][i] % 100 < spm else "psm")
        order = (SUFFIX, PREFIX, MIDDLE) if form[-1] == "spm" else (PREFIX, SUFFIX, MIDDLE)
        output.append(b"".join(m.encode() + parts[m] for m in order))
    plain = np.array([f == "plain" for f in form], dtype=bool)
    return [
        pa.array(runs.count, pa.int64()),
        pa.array(form, pa.string()),
        pa.array(prefix, pa.int64(), mask=plain),
        pa.array(middle, pa.int64(), mask=plain),
        pa.array(output, pa.binary()).cast(pa.string()),
    ]


def restored(output: Column, form: Column) -> Column:
    """The exact text behind an ``output``: its parts put back in order.

    Sentinels can't arise where parts meet, as none begins as another ends, so
    the first of each is the one put in.  Null for a null output.
    """
    body = F.substr(output, F.lit(4))
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}"), F.split(body, f"{PREFIX}|{MIDDLE}")
    return (
        F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(output)
    )
