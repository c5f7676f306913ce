import random
import re

import numpy as np
import pytest

from diurna.llm import components, jaccard

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sets(text, n=5):
    w = WORD.findall((text or "").lower())
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(rows, threshold=0.8):
    links = {k: 0 for k, _ in rows}
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    grams = [(k, sets(t)) for k, t in rows]
    for i, (a, x) in enumerate(grams):
        for b, y in grams[i + 1 :]:
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: (root(k), links[k]) for k, _ in rows}


@pytest.mark.parametrize("block", [jaccard.BLOCK, 16])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows, key = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((key, " ".join(copy)))
            key += 1
    # a large group of near copies, and of exact ones
    base = [rng.choice(words) for _ in range(90)]
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(90)] = rng.choice(words)
        rows.append((key, " ".join(copy)))
        key += 1
    rows += [(key + i, " ".join(base)) for i in range(20)] + [(key + 30, None), (key + 31, ""), (key + 32, "")]
    got = jaccard.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)


def test_split_components(spark, monkeypatch):
    """A long chain is split by bands, a clique beside it isn't; both lose nothing."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(5)
    stream = [f"w{rng.randrange(5000)}" for _ in range(900)]
    rows = [(i, " ".join(stream[4 * i : 4 * i + 64])) for i in range(200)]
    base = [f"v{rng.randrange(5000)}" for _ in range(80)]
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(80)] = f"u{i}"
        rows.append((1000 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    taken = []
    meetings = jaccard._meetings
    monkeypatch.setattr(jaccard, "_meetings", lambda *a: taken.append(meetings(*a)) or taken[-1])
    got = jaccard.join_similar(df).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)
    bands = {r["band"] != 0 for r in taken[0].collect()}
    assert bands == {True, False}


def test_null_keys_keep_their_links(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (None, text + " more"), (None, "alone " * 3), (None, text + " less"), (None, "some other words stand here"), (None, "some other words stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["class_id"]), r["n_links"], r["n_copies"]) for r in jaccard.join_similar(docs).collect())
    assert got == sorted([("1", 2, 1)] * 3 + [("None", 0, 1)] + [("None", 1, 2)] * 2)
    assert sorted(r["text"] for r in jaccard.drop_similar(docs).collect()) == sorted([text, "alone " * 3, rows[4][1]])


def test_repeated_keys_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", 0), (1, "quite another text of the same key", "b", 1), (2, text + " x", "c", 2), (3, None, "d", 3), (3, None, "e", 4), (1, text, "f", 5)]
    docs = spark.createDataFrame(rows, "`doc.id` long, `te xt` string, _kept string, `row.key` long")
    docs = docs.withColumn("key", docs["_kept"]).withColumn("tid", docs["_kept"]).withColumn("kept", docs["_kept"]).withColumn("k", docs["_kept"])
    out = jaccard.drop_similar(docs, "doc.id", "te xt")
    assert out.columns == docs.columns
    kept = sorted(r["_kept"] for r in out.collect())
    assert kept in (["a", "b", "d", "e"], ["b", "d", "e", "f"])
    assert jaccard.join_similar(docs, "doc.id", "te xt").columns[0] == "doc.id"


def test_pruning_is_safe():
    """Pairs at the threshold survive all looks but for the tolerance."""
    need = jaccard.survivors_need(0.8, 1e-6)
    rng = np.random.default_rng(1)
    hits = rng.random((200_000, jaccard.VALUES)) < 0.8
    lost = np.zeros(len(hits), bool)
    for n, k in need:
        lost |= hits[:, :n].sum(1) < k
    assert lost.mean() < 1e-3
    assert need[-1][1] > 0.4 * jaccard.VALUES  # and most others don't


@pytest.mark.parametrize("shared, total", [(4, 5), (8, 10), (16, 20), (40, 50)])
def test_small_sets_at_the_threshold_are_found(shared, total):
    """Real signatures of pairs at 0.8 survive pruning and share a band."""
    pairs = 20_000
    rng = np.random.default_rng(total)
    grams = rng.integers(0, 1 << 64, (pairs, total), np.uint64, endpoint=False)
    one, two = grams[:, :shared], grams
    a = jaccard._signatures(one.ravel(), np.arange(pairs + 1) * shared)
    b = jaccard._signatures(two.ravel(), np.arange(pairs + 1) * total)
    same = a == b
    lost = ~(jaccard._bands(a) == jaccard._bands(b)).any(1)
    for n, k in jaccard.survivors_need(0.8, jaccard.TOLERANCE):
        lost |= same[:, :n].sum(1) < k
    assert abs(same.mean() - 0.8) < 0.005
    assert lost.sum() <= 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (200, 100)] + [(300, 300 + i) for i in range(1, 20)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31))
    assert got[100] == got[101] == got[200] == 100
    assert all(got[300 + i] == 300 for i in range(20))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, none):
    got = jaccard.join_similar(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[5]["class_id"] == 1 and by[5]["n_links"] == 2 and by[1]["n_copies"] == 3
    assert by[3]["class_id"] == 3 and by[3]["n_links"] == 0 and by[2]["class_id"] == 2
    kept = jaccard.drop_similar(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert jaccard.join_similar(none).count() == 0
