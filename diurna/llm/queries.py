"""Queries of this package's operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filteraudit, fim, fingerprints, htmlmain, jaccard, langid, lm, packing, pii, sharding, toxicity, urlfilter


def vocabulary() -> str:
    """Path of the byte-level vocabulary that packing counts tokens by."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels not held out."""
    return toxicity.predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Rules of host and path; the longest that fits decides.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all page URLs.

    The tables have no block list, so one stands in that is fixed by rule: the
    canonical URLs whose SHA-256 begins with two zeros, one in 256.
    """
    pages = _table(spark, sf_dir, "pages")
    listed = pages.select("url").filter(F.sha2(F.encode(urlfilter.canonical(F.col("url")), "UTF-8"), 256).startswith("00"))
    return urlfilter.filter_urls(pages, URL_RULES, listed)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, checked for collisions."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    new = pii.verified(pii.replace_pii(docs, pii.key_of(spark)), strict=False)
    return new.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    return langid.predict(_table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's and the exact unigram score of all documents."""
    return lm.score_held_out(_table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all documents at five words and 0.8."""
    return jaccard.join_similar(_table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents share with the benchmark."""
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards, and over 17."""
    return sharding.shard_records(_table(spark, sf_dir, "documents"), 16)


def op11_htmlmain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return htmlmain.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill-in-middle form of all documents, and what is rebuilt from it."""
    out = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do in all their orders, for each source."""
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_urlfilter": op4_urlfilter,
    "op5_pii": op5_pii,
    "op6_langid": op6_langid,
    "op7_lm": op7_lm,
    "op8_sharding": op8_sharding,
    "op9_jaccard": op9_jaccard,
    "op10_decontam": op10_decontam,
    "op11_htmlmain": op11_htmlmain,
    "op12_fim": op12_fim,
    "op13_filteraudit": op13_filteraudit,
}

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_urlfilter": r"""
WITH parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '://[^?#]*[?]([^#]*)', 1) AS query
  FROM pages),
named AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS kept FROM parts),
canon AS (
  SELECT page_id, url, host, path,
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical
  FROM named),
rules(verdict, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM canon, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT c.page_id, c.host, c.path, c.canonical,
  coalesce(c.url IS NOT NULL AND starts_with(sha256(c.canonical), '00'), false) AS listed,
  f.rule,
  coalesce(f.verdict, CASE WHEN c.url IS NOT NULL AND starts_with(sha256(c.canonical), '00') THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN fits f USING (page_id)
""",
    "op10_decontam": rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS text
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS text
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item FROM spots JOIN windows USING (n, text)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc_id),
-- a run of occurrences on one diagonal of one item is one match
diagonal AS (
  SELECT DISTINCT s.doc_id, s.i, s.n, x.item, s.i - x.j AS shift
  FROM spots s JOIN (
    SELECT item, j, least(len(w), 13) AS n, array_to_string(w[j : j + least(len(w), 13) - 1], ' ') AS text
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS j FROM b WHERE len(w) > 0)) x USING (n, text)),
runs AS (
  SELECT doc_id, item, min(i) AS place, max(i) - min(i) + any_value(n) AS words
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, shift ORDER BY i) AS run FROM diagonal)
  GROUP BY doc_id, item, shift, run),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, CAST(item AS BIGINT), place) AS best_first FROM runs) WHERE best_first = 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated,
  coalesce(m.words, 0) AS match_words, m.item AS match_item, m.place - 1 AS match_at
FROM d LEFT JOIN hit h USING (doc_id) LEFT JOIN items t USING (doc_id) LEFT JOIN best m USING (doc_id)
""",
    "op12_fim": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
    "op13_filteraudit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.bad, false) AS bad,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0) AS before
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, CAST(step AS INTEGER) AS step_no, bit, n, n_good, n_toxic, mask,
    (mask & CAST(before AS BIGINT)) <> 0 AS gone, (mask & bit) <> 0 AS fails
  FROM c, s),
t AS (
  SELECT part, filter_order, step_no AS step, bit,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n_good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n_toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step_no, bit),
-- a filter's removals at any step, over all orders
v AS (SELECT part, bit, CAST(sum(removed) AS BIGINT) AS shapley FROM t GROUP BY part, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM t JOIN v USING (part, bit)
""",
}
