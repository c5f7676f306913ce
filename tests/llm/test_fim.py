import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from diurna.llm import fim
from diurna.llm.textbatch import text_bytes

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]*[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"}


def units(text, unit):
    return [u for u in re.findall(UNITS[unit], text) if u]


def brute(key, text, unit="line", rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = units(text, unit)
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, rows=120):
    r = random.Random(seed)
    alphabet = ["\n", "\n", "\r\n", " ", "a", "Bc", "é", "漢", "😀", "<", "<P", "S>", "<M>", "\t", "\x0b"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 40))) for _ in range(rows)] + ["\n", "\n\n\n", "x", "x\n", "\nx", ""]


@pytest.mark.parametrize("unit", ["line", "char", "word"])
def test_every_cut_is_where_units_end(unit):
    rows = texts(3)
    data, offsets = text_bytes(pa.array(rows))
    runs = fim.class_runs(data, offsets, unit)
    for i, text in enumerate(rows):
        u = units(text, unit)
        assert runs.count[i] == len(u), text
        want = [offsets[i] + len("".join(u[:k]).encode()) for k in range(len(u) + 1)]
        got = runs.cut(np.full(len(want), i), np.arange(len(want)))
        assert got.tolist() == want, text


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("char", 60, 20), ("word", 100, 100)])
def test_against_brute_force(spark, unit, rate, spm):
    rows = list(enumerate(texts(5)))
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, rate=rate, spm=spm)
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, unit, rate, spm)
        assert r.back == r.text
    assert {r.form for r in got} >= {"plain", "spm"}


def test_odd_rows(spark, odd, none):
    got = fim.transform(odd.withColumnRenamed("bucket", "n").withColumn("a.b", F.lit(1)))
    rows = got.collect()
    assert len(rows) == odd.count() and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "a.b", *fim.ADDED]
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
    assert fim.transform(none).count() == 0


def test_long_texts_take_linear_time(spark):
    text = "a\n\n" * 2_000_000
    r = fim.transform(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    r = r.select("n", "form", F.col("back") == F.col("text")).first()
    assert r[0] == 4_000_000 and r[1] != "plain" and r[2]
