"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir).  ``run`` writes what a stage
returns to the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.llm import decontam, jaccard, langid, packing, pii
from diurna.llm.queries import vocabulary
from diurna.llm.scratch import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; only those without a letter go."""
    model = langid.train(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    judged = langid.identify(rows, model, keep=["_row"])
    return judged.filter(F.col("lang_pred") != langid.UNDETERMINED).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least doc_id, nulls last."""
    return jaccard.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` follows the text.

    Surrogates are checked for collisions.
    """
    new = pii.verified(pii.replace_pii(docs, pii.key_of(spark)), strict=False)
    return new.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: SQL can't express Bloom filters, MinHash, keyed permutations or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
