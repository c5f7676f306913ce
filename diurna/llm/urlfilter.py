"""URL filters: rules by host and path, then a list of canonical URLs.

The list may be large.  A blocked Bloom filter of it, a table of at most
``MAX_BLOCKS`` blocks that every task gets, settles nearly all URLs; only
possible hits are shuffled to an exact hash join with the list, which removes
the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Words of 64 bits in a block; a key sets one bit in each.
WORDS = 8
BITS_PER_KEY = 16
#: Bound of the broadcast filter: 2**19 blocks of 64 bytes.  A longer list
#: raises the share of false positives, not the result.
MAX_BLOCKS = 1 << 19
MAX_RULES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``? #`` or the end; without ``://`` empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One form for URLs of one page.

    No scheme, fragment, ``www.``, trailing slash or ``utm_`` parameter; the
    other parameters sorted.
    """
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/\z", "")  # \z, as $ also fits before a last line break
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``, or null.

    ``rules`` are (verdict, host and path), such as ("block", "net/es/").  A
    rule fits its host and all subdomains if the URL's path starts with its
    own.  Of equally long rules the one of the longer host wins, then the last
    by name.
    """
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules for one expression: list their URLs instead")
    fits = []
    for verdict, rule in rules:
        at = rule.find("/")
        name, prefix = (rule[:at], rule[at:]) if at >= 0 else (rule, "")
        ok = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fits.append(
            F.when(
                ok,
                F.struct(F.lit(len(rule)).alias("length"), F.lit(len(name)).alias("host"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")),
            )
        )
    if not fits:
        return F.lit(None).cast("struct<length:int,host:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def _bits(key: Column) -> tuple[Column, list[Column]]:
    """Hash that picks the block, and for each word the place of its bit."""
    second = F.xxhash64(key, F.lit("bits"))
    return F.xxhash64(key), [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def blocked_bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: ``_block`` and its words ``_w0`` and on."""
    pick, places = _bits(F.col(key))
    one = F.lit(1).cast("long")
    return (
        listed.select(F.pmod(pick, F.lit(blocks)).alias("_block"), *[p.alias(f"_p{i}") for i, p in enumerate(places)])
        .groupBy("_block")
        .agg(*[F.bit_or(F.call_function("shiftleft", one, F.col(f"_p{i}"))).alias(f"_w{i}") for i in range(WORDS)])
    )


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    listed: DataFrame,
    key: str = "page_id",
    url: str = "url",
    listed_url: str = "url",
) -> DataFrame:
    """Judge every URL.

    ``listed`` holds the URLs to block, in any form; nulls and repeats in it do
    no harm.  A rule decides where one fits; elsewhere a URL is blocked if its
    canonical form is listed, else allowed.  Null URLs, or those without
    ``://``, have an empty host and path, fit no rule, and are listed only if
    the list has such a one.

    Returns ``key, host, path, canonical, listed, rule, verdict``, a row for
    each input row.
    """
    names = materialize(listed.filter(F.col(listed_url).isNotNull()).select(canonical(F.col(listed_url)).alias("canonical")).distinct())
    n = names.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_KEY // (64 * WORDS))))
    bloom = blocked_bloom(names, "canonical", blocks)
    u = F.col(url)
    rows = pages.select(F.col(key).alias("_key"), host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("canonical"))
    pick, places = _bits(F.col("canonical"))
    rows = rows.withColumn("_block", F.pmod(pick, F.lit(blocks))).join(F.broadcast(bloom), "_block", "left")
    hit = F.lit(True)
    for i, p in enumerate(places):
        hit = hit & (F.call_function("shiftright", F.col(f"_w{i}"), p).bitwiseAND(F.lit(1)) == 1)
    rows = rows.select("_key", "host", "path", "canonical", F.coalesce(hit, F.lit(False)).alias("_possible"))
    possible = rows.filter("_possible").join(names.withColumn("_listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    judged = rows.filter("not _possible").withColumn("listed", F.lit(False)).unionByName(possible.withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_listed"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("_key").alias(key), "host", "path", "canonical", "listed", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict")
    )
