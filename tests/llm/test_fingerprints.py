import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from diurna.llm import fingerprints as fp


def x64(*values, seed=42):
    h = seed
    for v in values:
        if isinstance(v, str):
            h = xxhash.xxh64_intdigest(v.encode(), h)
        else:
            h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), h)
    return h


def brute(text, m=fp.M, k=fp.K, l=fp.L):  # noqa: E741
    """Order MinHash with plain Python sets and sorting."""
    tokens = []
    for word in (text or "").split():
        tokens += [word[i : i + fp.TOKEN_CHARS] for i in range(0, len(word), fp.TOKEN_CHARS)]
    if not tokens:
        return [0] * m
    if len(tokens) < k:
        grams = [(x64(*tokens) & fp._HASH, 0)]
    else:
        grams = [(x64(*tokens[i : i + k]) & fp._HASH, i) for i in range(len(tokens) - k + 1)]
    seen, elements = {}, []
    for h, place in grams:
        n = seen.get(h, 0)
        seen[h] = n + 1
        if n:
            z = h | 0
            elements.append(((xxhash.xxh64_intdigest(int(n).to_bytes(4, "little"), xxhash.xxh64_intdigest(z.to_bytes(8, "little"), 42)) & fp._HASH), place))
        else:
            elements.append((h, place))
    out = []
    shift = 63 - max(1, (m - 1).bit_length())
    for j in range(m):

        def rank(element):
            h, place = element
            if h >> shift == j:
                return 0, h, place
            mixed = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
            return 1, mixed & fp._HASH, place

        chosen = [h | place for _, h, place in sorted(map(rank, elements))[:l]]
        chosen.sort(key=lambda v: v & fp._PLACE)
        inner = x64(*[v >> fp.PLACE_BITS for v in chosen])
        out.append(x64(inner - (1 << 64) if inner >> 63 else inner))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    words = ["aa", "bb", "cc", "dd", "ee", "averyveryverylongword"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 40, 200, 900)] + [None, "x" * 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [v & (1 << 64) - 1 for v in r["s"]] for r in df.select("i", fp.order_minhash(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_order_and_repeats_matter(spark):
    a = " ".join(f"w{i}" for i in range(300))
    swapped = " ".join(f"w{i}" for i in [*range(150, 300), *range(150)])
    df = spark.createDataFrame([(a, swapped, a + " " + a)], "a string, b string, c string")
    one = df.select(*[fp.to_string(fp.order_minhash(F.col(c))).alias(c) for c in "abc"])
    row = one.select(fp.likeness(F.col("a"), F.col("a")).alias("same"), fp.likeness(F.col("a"), F.col("b")).alias("moved"), fp.likeness(F.col("a"), F.col("c")).alias("twice")).first()
    assert row["same"] == 1.0
    assert 0.2 < row["moved"] < 0.8  # pairs across the cut change their order
    assert row["twice"] < 1.0


@pytest.mark.parametrize("partitions", [1, 7])
def test_edited_texts(spark, partitions):
    rng = random.Random(1)
    rows = [(i * 3, "".join(rng.choice("abc dé漢 ") for _ in range(rng.randint(0, 60))) or None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(df).collect()}
    assert len(got) == 40
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % 40][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert got[key]["n_chars"] == len(text)
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[key]["fingerprint"] == "".join(f"{v & 0xFFFFFFFF:08X}" for v in brute(text))


def test_odd_rows(spark, odd, none):
    rows = fp.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 5)}
    assert len(same) == 1
    assert fp.edited_fingerprints(none).count() == 0
    kept = fp.fingerprint(odd)
    assert kept.columns == [*odd.columns, "fingerprint"]
    assert "PythonUDF" not in kept._jdf.queryExecution().toString()
