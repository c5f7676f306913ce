"""Queries of a chosen ensemble and of files read by name, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import champion, kernels, metrics, search, trees
from ..operators.lineage import checkpointed, shared_folder
from ..sources import tables
from . import bindings as b
from .learner_queries import _vectors
from .model_queries import SEED
from .signal_queries import _r, rounded
from .tree_queries import D, _rows

MEMBERS = [champion.Member("dem_a", "cn_mci_a", 0.9, 0.1), champion.Member("dem_a", "cn_mci_b", cn_mci_temperature=1.5)]
WEIGHTS = [[2, 2, 1], [1, 1, 2]]
PARAMETERS = {"dem_a": {"rounds": 3}, "cn_mci_a": {"rounds": 3}, "cn_mci_b": {"rounds": 2, "rate": 0.2, "leaves": 4}}


def _fitted(data: DataFrame) -> champion.Champion:
    return champion.fit(data.filter("subject % 5 <> 0"), [f"x{i}" for i in range(D)], MEMBERS, WEIGHTS, [0.0, 0.1, 0.3], PARAMETERS)


def _folder(spark: SparkSession) -> str:
    """A new folder that all machines share."""
    return f"{shared_folder(spark)}/diurna-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def champion_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A champion saved, another fitted anew on the same rows: both score the rest, as the one read from disk does."""
    data = _rows(spark, sf_dir)
    folder = _folder(spark)
    champion.save(spark, _fitted(data), folder)
    saved = champion.load(spark, folder).predict(data.filter("subject % 5 = 0"))
    return rounded(champion.reproduction(saved, _fitted(data).predict(data.filter("subject % 5 = 0"))), 5)


def champion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and classes of all by the champion's votes and offsets."""
    data = _rows(spark, sf_dir)
    return rounded(_fitted(data).predict(data))


def branch_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of features in both branches over the champion's members, explained on the rows it hasn't seen."""
    data = _rows(spark, sf_dir)
    best = _fitted(data)
    seen, rest = data.filter("subject % 5 <> 0"), data.filter("subject % 5 = 0")
    parts = []
    for role in champion.ROLES:
        ground = champion.background_rows(seen, role, SEED, 20)
        parts += [(i, role, champion.branch_contributions(rest, best, i, role, ground, SEED)) for i in range(len(best.members))]
    return rounded(champion.branch_importance(parts, best)[1])


def files_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written to CSV files of two orders of columns, read by name, summed by customer."""
    names = ["o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"]
    orders = b.table(spark, sf_dir, "orders").select(*names)
    folder = _folder(spark)
    for i, kept in enumerate((names, [*names[2:], *names[:2]])):
        orders.filter(F.pmod("o_orderkey", F.lit(2)) == i).select(*kept).write.option("header", True).csv(f"{folder}/{i}")
    rows = tables.read_by_name(spark, [f"{folder}/0", f"{folder}/1"], ["o_custkey", "o_totalprice", "o_orderpriority"])
    price = F.col("o_totalprice").cast("double")
    return rounded(
        rows.groupBy(F.col("o_custkey").cast("long").alias("customer")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(price).alias("total"), F.min(price).alias("least"), F.max("o_orderpriority").alias("last_priority")
        )
    )


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings filled and scaled."""
    from pyspark.ml.functions import vector_to_array

    return _vectors(spark, sf_dir).select("subject", "y", vector_to_array("features").alias("x"))


def guided_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five trials of two families, three of them guided: log loss on rows that no trial has learned from."""
    data = {"histgb": _rows(spark, sf_dir), "extratrees": checkpointed(_filled(spark, sf_dir))}
    edges = trees.thresholds(trees.bins(trees.rows_of(data["histgb"].filter("subject % 5 <> 0"))), D)

    def judged(values: dict) -> float:
        own = {k.split("_", 1)[1]: v for k, v in values.items() if k != "family"}
        rows = data[values["family"]]
        train, test = rows.filter("subject % 5 <> 0"), rows.filter("subject % 5 = 0")
        model = trees.boost(train, D, edges=edges, **own) if values["family"] == "histgb" else trees.extra_trees(train, D, seed=SEED, **own)
        said = trees.scored(test, model.proba)
        return -said.agg(metrics.log_loss(said)).first()[0]

    out = search.study(search.Log(spark, _folder(spark)), "joint", search.joint_space(), judged, 5, SEED, start=2)
    return rounded(out.select("trial", "parameters", "status", "objective", "error"))


def landmark_ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all by kernel ridge through 256 landmarks, learned from four in five subjects."""
    data = _filled(spark, sf_dir)
    model = kernels.ridge(data.filter("subject % 5 <> 0"), 0.01, 1.0, most=256, seed=SEED)
    return rounded(trees.scored(data, model.proba))


def landmark_machine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all by margin machines of pairs of classes through 128 landmarks, learned from four in five subjects."""
    data = checkpointed(_filled(spark, sf_dir))
    model = kernels.machine(data.filter("subject % 5 <> 0"), 0.01, 1.0, most=128, seed=SEED)
    return rounded(trees.scored(data, model.proba))


QUERIES = {f.__name__: f for f in (champion_reproduction, champion_classes, branch_consensus, files_by_name, guided_search, landmark_ridge_scores, landmark_machine_scores)}
ORACLE_SQL: dict[str, str] = {
    # a law: models fitted on the same rows, and one read from disk, score alike
    "champion_reproduction": "SELECT count(*) AS n, 0.0::DOUBLE AS gap, count(*) AS same FROM embeddings WHERE vec_id % 5 = 0",
    "files_by_name": f"""
SELECT CAST(o_custkey AS BIGINT) AS customer, count(*) AS n, {_r("sum(CAST(o_totalprice AS DOUBLE))", "total")}, {_r("min(CAST(o_totalprice AS DOUBLE))", "least")}, max(o_orderpriority) AS last_priority
FROM orders GROUP BY o_custkey""",
}
