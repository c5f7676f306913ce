import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from diurna.llm import sharding, urlfilter
from diurna.llm.queries import URL_RULES


def test_urls_by_hand(spark):
    urls = [
        ("http://www.Example.com/en/x?a=1#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/x", "m.example.com", "/en/x", "example.com/en/", "block"),
        ("https://myexample.com/en/x", "myexample.com", "/en/x", "com/", "allow"),
        ("https://a.b.net/es/", "a.b.net", "/es/", "net/es/", "block"),
        ("https://a.org/en/1?b=2&utm_x=1&a=1", "a.org", "/en/1", None, "block"),
        ("https://a.org/en/2", "a.org", "/en/2", None, "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://?q", "", "", None, "allow"),
        ("A://B.NET:80/fr/?#://c", "b.net:80", "/fr/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("http://www.a.org/en/1/?a=1&b=2#z",), ("http://www.a.org/en/1/?a=1&b=2#z",), (None,)], "url string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages, URL_RULES, listed).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict)


@pytest.mark.parametrize("most", [urlfilter.MAX_BLOCKS, 1])
def test_false_positives_are_removed(spark, monkeypatch, most):
    """A filter of one block passes nearly all; the join decides all the same."""
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", most)
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), (F.col("id") % 700).cast("string")).alias("url"))
    listed = pages.filter("page_id < 300")
    got = urlfilter.filter_urls(pages, [], listed).collect()
    assert len(got) == 2000
    assert all((r["verdict"] == "block") == (r["page_id"] % 700 < 300) == r["listed"] for r in got)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.filter_urls(pages, URL_RULES, pages).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urlfilter.filter_urls(one, [], pages).first()["verdict"] == "allow"


def shard_of(key, n):
    start = xxhash.xxh64_intdigest((str(key) if key is not None else "\0null").encode(), 42)
    start = xxhash.xxh64_intdigest((start - (1 << 64) if start >> 63 else start).to_bytes(8, "little", signed=True), 42)
    import math

    best = None
    for s in range(n):
        u = ((xxhash.xxh64_intdigest(s.to_bytes(4, "little"), start) >> 11) + 0.5) / 2**53
        score = -1 / math.log(u)
        if best is None or score > best[0]:
            best = (score, s)
    return best[1]


def test_shards_match_brute_force(spark, odd, none):
    out = sharding.shard_records(odd)
    rows = out.collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 1, zlib.crc32(body), "key")
        assert r["shard"] == shard_of(r["doc_id"], 16) and r["grown_shard"] == shard_of(r["doc_id"], 17)
    assert sharding.shard_records(none).count() == 0


def test_growth_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_records(docs).collect()
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    moved = sum(r["grown_shard"] == 16 for r in rows)
    assert abs(moved - 20_000 / 17) < 150
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - 1250) < 150


def test_weights(spark):
    rng = random.Random(0)
    docs = spark.createDataFrame([(rng.randrange(1 << 40), "x") for _ in range(12_000)], "doc_id long, text string")
    n = {r["shard"]: r["count"] for r in sharding.shard_records(docs, [1.0, 0.0, 2.0, 3.0]).groupBy("shard").count().collect()}
    assert 1 not in n and abs(n[0] - 2000) < 200 and abs(n[3] - 6000) < 250
    with pytest.raises(ValueError):
        sharding.shard_records(docs, [0.0])


def test_canonical_keeps_a_slash_before_a_line_break(spark):
    from diurna.llm.urlfilter import canonical

    df = spark.createDataFrame([(0, "http://www.a.com/x/"), (1, "http://a.com/x/\n"), (2, None)], "i int, u string")
    got = {r["i"]: r["c"] for r in df.select("i", canonical(F.col("u")).alias("c")).collect()}
    assert got == {0: "a.com/x", 1: "a.com/x/\n", 2: ""}
