import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from diurna.llm import filteraudit as fa
from diurna.llm.textbatch import text_bytes

SPACE = r"[^\x20\x09-\x0D]+"


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    bad = {k for k, _, t in labels if t == 1 and k is not None}
    rows = []
    for key, text, source in docs:
        text = text or ""
        w = re.findall(SPACE, text)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in docs):
            fails.add("E")
        rows.append((source or "", fails, key in good, key in bad))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            out_before = []
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in out_before)
                unique = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, order, step] = [len(kept), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
                out_before += gone
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def read(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_against_brute_force(spark):
    r = random.Random(1)
    bases = []
    for _ in range(30):
        words = [r.choice(["alpha", "Beta", "g", "é", "漢字", "DELTA", "a" * 70]) + str(r.randrange(r.choice([3, 400]))) for _ in range(r.choice([0, 5, 199, 200, 260]))]
        bases.append(r.choice([" ", "\n", "\t \x0b"]).join(words) + r.choice(["", "", " #", "|"]))
    docs = [(r.choice([i, i, i, None, i // 2]), r.choice([*bases, None]), r.choice(["s", "t", None, ""])) for i in range(120)]
    labels = [(r.randrange(120), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    got = fa.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert read(got) == brute(docs, labels)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0, "x"), (4, 0, 1, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, text string")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert read(fa.audit(odd.withColumnRenamed("bucket", "mask").withColumnRenamed("size", "n"), labels)) == brute(rows, [(4, 1, 0), (4, 0, 1)])
    assert fa.audit(none, labels).count() == 0
    assert {r.good_lost for r in fa.audit(odd, labels.limit(0)).collect()} == {0}


def counts(texts, **kw):
    data, offsets = text_bytes(pa.array(texts))
    words, distinct = fa.distinct_words(data, offsets, **kw)
    return words.tolist(), distinct.tolist()


@pytest.mark.parametrize("hashes", [None, lambda d, a, b, v: np.zeros(len(a), np.uint64), lambda d, a, b, v: (b - a).astype(np.uint64)])
def test_distinct_words_hold_under_colliding_hashes(hashes):
    r = random.Random(2)
    texts = [" ".join(r.choice(["ab", "ba", "abcdefgh", "abcdefgi", "x" * 9, "x" * 200, "x" * 199 + "y", "é"]) for _ in range(r.randrange(0, 30))) for _ in range(50)]
    want = [len(re.findall(SPACE, t)) for t in texts], [len(set(re.findall(SPACE, t))) for t in texts]
    assert counts(texts, **({"hashes": hashes} if hashes else {})) == want


def test_one_long_word_twice_is_one_word():
    assert counts(["z" * 3_000_000 + " " + "z" * 3_000_000, "a"]) == ([2, 1], [1, 1])
