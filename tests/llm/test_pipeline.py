import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

WORDS = {
    "en": "the of and in that is was for with this from have their been were",
    "de": "der die und den von ist mit sich auch für nicht eine nach wird",
}


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    import random

    rng = random.Random(8)
    rows = []
    for i in range(100, 160):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) + str(rng.randrange(99)) for _ in range(40)), lang, "s", 1, "S", 1))
    copy = rows[0][1]
    item = " ".join(f"item{k}" for k in range(20))
    rows += [(200, copy, "en", "s", 1, "S", 1), (201, copy + " end", "en", "s", 1, "S", 1), (202, item + " tail", "en", "s", 1, "S", 1), (203, "write to bob@example.com please now", "en", "s", 1, "S", 1)]
    docs = odd.filter("doc_id is not null").unionByName(spark.createDataFrame(rows, odd.schema))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    gone = [{2, 3, 6, 9}, {5, 200, 201}, {202}, set()]
    keys = {r["doc_id"] for r in docs.collect()}
    for (name, stage), left in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        docs = stage(spark, docs, tables)
        assert docs.columns == columns, name
        docs = corpus_pipeline.materialize(docs)
        keys -= left
        found = [r["doc_id"] for r in docs.collect()]
        # the repeated row goes with the near duplicates
        assert set(found) == keys and len(found) == len(keys) + (name == "language"), name
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert "bob@" not in texts[203] and texts[203].endswith(".com please now")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {r["doc_id"] for r in pieces.collect()} == keys
    assert pieces.count() == corpus_pipeline.run(spark, tables).count()


def test_stages_keep_odd_columns(spark, tables):
    """Names that hold dots or clash with those of the operators."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = {"a.b": "size", "_kept": "doc_id", "_row": "lang", "key": "text", "digest": "text", "items": "size", "lang_pred": "lang", "entities": "size", "_text": "lang", "_body": "text"}
    docs = docs.select("*", *[docs[c].alias(n) for n, c in names.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        assert out.count() > 50, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() > 50


def test_a_corpus_without_labels_stays(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, bare, tables).collect()}
    assert kept == {r["doc_id"] for r in corpus_pipeline.language(spark, docs, tables).collect()}


def test_empty_tables_go_through(spark, tables, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    assert docs.count() == 0
