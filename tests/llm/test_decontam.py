import random
import re

from diurna.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(docs, items):
    windows: dict = {}
    for key, text in items:
        w = WORD.findall((text or "").translate(LOW))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(key))
    out = {}
    for key, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= ids
        out[key] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"W{i}" for i in range(12)] + ["É", "x-y", "7"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 5, 13, 14, 40]))) for i in range(12)] + [(99, None), (3, say(20))]
    docs = []
    for i in range(80):
        text = say(rng.randint(0, 60))
        if i % 3 == 0:
            text += ", " + (items[i % 12][1] or "") + "; " + say(5)
        docs.append((i, text))
    docs.append((100, None))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block in (decontam.BLOCK_BYTES, 300):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontam.find_matches(d, b, block_bytes=block).collect()}
        assert got == want


def longest(text, items):
    """(words, item, place, place in the item) of the longest match that holds a window."""
    w = WORD.findall((text or "").translate(LOW))
    best = None
    for key, other in items:
        x = WORD.findall((other or "").translate(LOW))
        for i in range(len(w)):
            for j in range(len(x)):
                n = 0
                while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                    n += 1
                if n >= min(13, len(x)):
                    own = (-n, key, i, j)
                    best = own if best is None or own < best else best
    return (0, None, None, None) if best is None else (-best[0], *best[1:])


def test_longest_matches_are_located(spark):
    rng = random.Random(11)
    words = ["a", "b"] + [f"w{i}" for i in range(5)]
    stream = [rng.choice(words) for _ in range(400)]
    cut = lambda n: " ".join(stream[(a := rng.randrange(400 - n)) : a + n])
    items = [(i, cut(rng.choice([1, 4, 13, 20, 60]))) for i in (2, 3, 10, 11, 20, 21)] + [(10, cut(50))]
    docs = [(i, " ".join([cut(rng.choice([5, 30, 90])), "x", cut(20)])) for i in range(30)] + [(50, None), (51, "")]
    docs += [(60, " ".join(stream)), (61, "b " * 40)]
    items += [(30, "b " * 30), (4, "b " * 30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 150):
        got = {r["doc_id"]: tuple(r[c] for c in ("match_words", "match_item", "match_at", "match_item_at")) for r in decontam.find_matches(d, b, block_bytes=block).collect()}
        assert got == {key: longest(text, items) for key, text in docs}


def test_ties_go_to_the_first_item(spark):
    """Ids compare as what they are, in one block and over several; lists are sorted as strings."""
    one, two = (" ".join(f"{c}{k}" for k in range(13)) for c in "xy")
    d = spark.createDataFrame([(1, f"{one} - {two}")], "doc_id long, text string")
    for kind, first in (("long", 2), ("string", "10")):
        b = spark.createDataFrame([(10, one), (2, two)], "item_id long, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
        for block in (decontam.BLOCK_BYTES, 60):
            r = decontam.find_matches(d, b, block_bytes=block).first()
            assert (r["match_item"], r["items"], r["n_hit"]) == (first, ["10", "2"], 26)


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "one two", 5, 6)], "doc_id long, text string, n_words long, `a.b` int")
    b = spark.createDataFrame([(1, "three")], "item_id long, text string")
    assert decontam.find_matches(d, b).columns.count("n_words") == 1
    assert decontam.remove_contaminated(d, b).first()["a.b"] == 6


def test_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, "")], "item_id long, text string")
    clean = decontam.remove_contaminated(odd, b)
    assert clean.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in clean.collect()) == [-1, 2, 3, 4, 6, 7, 8, 9]
    assert decontam.remove_contaminated(none, b).count() == 0
    assert decontam.remove_contaminated(odd, b.limit(0)).count() == odd.count()
