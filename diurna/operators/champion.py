"""A chosen ensemble: saved, read back, reproduced, explained, and put to new recordings.

Its members are pairs of boosted models in a hierarchy: one tells the last
class from the others, one the second from the first.  Each branch is
calibrated by a temperature and a bias; members vote with a weight for each
class, and offsets decide.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import trees
from .lineage import checkpointed

#: The two branches of a member: what they tell, the model and calibration they use, the class whose vote they have.
ROLES = {"dem": 2, "cn_mci": 1}


@dataclass(frozen=True)
class Member:
    """A hierarchy of two models, by name, and how each is calibrated."""

    dem: str
    cn_mci: str
    dem_temperature: float = 1.0
    dem_bias: float = 0.0
    cn_mci_temperature: float = 1.0
    cn_mci_bias: float = 0.0


@dataclass
class Champion:
    models: dict[str, trees.Boosted]
    members: list[Member]
    weights: list[list[float]]  # of each member, by class
    offsets: list[float]
    features: list[str]
    settings: dict = field(default_factory=dict)

    def branch(self, member: Member, role: str, x: np.ndarray) -> np.ndarray:
        """A branch's calibrated probability of its later class."""
        p = self.models[getattr(member, role)].proba(x)[:, 1].clip(1e-9, 1 - 1e-9)
        z = np.log(p / (1 - p)) / getattr(member, f"{role}_temperature") + getattr(member, f"{role}_bias")
        return 1 / (1 + np.exp(-z))

    def proba(self, x: np.ndarray) -> np.ndarray:
        """Weighted votes of all members, as shares of a row."""
        w = np.array(self.weights, float)
        w = w / w.sum(0)
        total = np.zeros((len(x), 3))
        for member, own in zip(self.members, w, strict=True):
            d, q = self.branch(member, "dem", x), self.branch(member, "cn_mci", x)
            total += own * _shares(np.stack([(1 - d) * (1 - q), (1 - d) * q, d], 1))
        return _shares(total)

    def predict(self, data: DataFrame) -> DataFrame:
        """``subject, y, p0, p1, p2, predicted``; ties go to the earlier class.  One pass."""
        said = trees.scored(data, self.proba)
        z = [F.ln(F.col(f"p{k}")) + F.lit(float(o)) for k, o in enumerate(self.offsets)]
        top = F.greatest(*z)
        return said.withColumn("predicted", F.when(z[0] == top, 0).when(z[1] == top, 1).otherwise(2))


def _shares(p: np.ndarray) -> np.ndarray:
    p = p.clip(1e-12, None)
    return p / p.sum(1, keepdims=True)


def fit(data: DataFrame, features: Sequence[str], members: Sequence[Member], weights: Sequence[Sequence[float]], offsets: Sequence[float], parameters: dict[str, dict]) -> Champion:
    """Fit each named model on its own task's rows: all for ``dem``, the first two classes for ``cn_mci``.

    Rows are written once for all models; bins are cut once, on all rows given,
    and shared by the models.
    """
    data = checkpointed(trees.rows_of(data))
    edges = trees.thresholds(trees.bins(data), len(features))
    tasks = {m.dem: "dem" for m in members} | {m.cn_mci: "cn_mci" for m in members}
    models = {}
    for name, task in sorted(tasks.items()):
        rows = data.withColumn("y", (F.col("y") == 2).cast("int")) if task == "dem" else data.filter("y <> 2")
        models[name] = trees.boost(rows, len(features), classes=2, edges=edges, **parameters.get(name, {}))
    return Champion(models, list(members), [list(w) for w in weights], list(offsets), list(features), {"parameters": parameters})


def digest(nodes: Sequence, settings: str) -> str:
    """One digest of a champion's nodes, in any order, and its settings."""
    rows = sorted(json.dumps(r.asDict() if hasattr(r, "asDict") else r, sort_keys=True) for r in nodes)
    return hashlib.sha256("\n".join([settings, *rows]).encode()).hexdigest()


def save(spark: SparkSession, champion: Champion, folder: str) -> None:
    """Write a champion to a folder that all machines share; one that holds a champion is an error."""
    tables = [trees.model_table(spark, m).withColumn("model", F.lit(n)) for n, m in champion.models.items()]
    nodes = tables[0]
    for t in tables[1:]:
        nodes = nodes.unionByName(t)
    rest = {k: v for k, v in asdict(champion).items() if k != "models"}
    settings = json.dumps(rest, sort_keys=True)
    nodes.coalesce(1).write.parquet(f"{folder}/nodes")
    spark.createDataFrame([(settings, digest(nodes.collect(), settings))], "settings string, digest string").coalesce(1).write.parquet(f"{folder}/settings")


def load(spark: SparkSession, folder: str) -> Champion:
    """Read a champion; one whose nodes or settings have changed since it was saved is an error."""
    settings, kept = spark.read.parquet(f"{folder}/settings").first()
    table = spark.read.parquet(f"{folder}/nodes")
    nodes = table.collect()  # a row for each node of its trees
    if digest(nodes, settings) != kept:
        raise ValueError(f"the model in {folder} isn't the one that was saved")
    rest = json.loads(settings)
    names = sorted({r["model"] for r in nodes})
    models = {n: trees.model_of(table.filter(F.col("model") == n).drop("model")) for n in names}
    return Champion(models, [Member(**m) for m in rest["members"]], rest["weights"], rest["offsets"], rest["features"], rest["settings"])


def reproduction(saved: DataFrame, again: DataFrame, relative: float = 1e-4, absolute: float = 1e-6) -> DataFrame:
    """Largest gaps between saved and new scores, one row: ``n, gap, same``.

    A subject that one of them lacks, or a score that differs by more than
    ``absolute`` and ``relative`` times the saved one, is an error.
    """
    p = [f"p{k}" for k in range(3)]
    both = saved.select("subject", *[F.col(c).alias(f"_{c}") for c in p], F.col("predicted").alias("_predicted")).join(again.select("subject", *p, "predicted"), "subject", "full")
    gaps = [F.abs(F.col(c) - F.col(f"_{c}")) for c in p]
    near = F.lit(True)
    for g, c in zip(gaps, p, strict=True):
        near = near & F.coalesce(g <= absolute + relative * F.abs(F.col(f"_{c}")), F.lit(False))
    gap = F.when(near, F.greatest(*gaps)).otherwise(F.raise_error(F.concat(F.lit("scores not reproduced: "), F.col("subject").cast("string"))).cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("gap"), F.count(F.when(F.col("predicted") == F.col("_predicted"), 1)).alias("same"))


# ---- explanations of branches ---------------------------------------------


def branch_contributions(data: DataFrame, champion: Champion, number: int, role: str, background: np.ndarray, seed: int, rounds: int = 1) -> DataFrame:
    """What features add to a calibrated branch's score: ``subject, feature, contribution``.

    Explained are the subjects of the branch's own task, held against
    ``background`` rows of the same; each subject's features join in a random
    order and its reverse.  Contributions add up to the subject's score less
    the background's mean.  A step changes one column of all background rows,
    and a subject's steps are scored together.
    """
    member = champion.members[number]
    rows = data.filter("y <> 2") if role == "cn_mci" else data
    d = background.shape[1]
    kind = data.schema["subject"].dataType.simpleString()

    def explain(batches):
        import pandas as pd

        for part in batches:
            for subject, x in zip(part["subject"], part["x"], strict=True):
                x = np.array([np.nan if v is None else v for v in x], float)
                phi = np.zeros(d)
                turns = []
                for r in range(rounds):
                    order = np.random.default_rng([seed, r, int(hashlib.sha256(str(subject).encode()).hexdigest()[:12], 16)]).permutation(d)
                    turns += [order, order[::-1]]
                for turn in turns:
                    # row block i has the first i features of the turn from the subject
                    place = np.empty(d, np.int64)
                    place[turn] = np.arange(d)
                    taken = place[None, :] < np.arange(d + 1)[:, None]
                    stack = np.where(taken[:, None, :], x, background[None]).reshape(-1, d)
                    means = champion.branch(member, role, stack).reshape(d + 1, -1).mean(1)
                    phi[turn] += np.diff(means)
                yield pd.DataFrame({"subject": subject, "feature": np.arange(d), "contribution": phi / len(turns)})

    return rows.select("subject", F.col("x").cast("array<double>").alias("x")).mapInPandas(explain, f"subject {kind}, feature int, contribution double")


def background_rows(data: DataFrame, role: str, seed: int, most: int = 80) -> np.ndarray:
    """Up to ``most`` rows of a branch's task, chosen by a hash of the subject; NaN where missing."""
    from .folds import hash_int

    rows = data.filter("y <> 2") if role == "cn_mci" else data
    found = rows.select(hash_int(F.lit(seed), F.col("subject")).alias("h"), "subject", "x").orderBy("h", "subject").limit(most).collect()
    return np.array([[np.nan if v is None else v for v in r["x"]] for r in found], float)


def branch_importance(parts: Sequence[tuple[int, str, DataFrame]], champion: Champion) -> tuple[DataFrame, DataFrame]:
    """Mean absolute contributions by member and role, and their consensus over members.

    Within a member shares of features add up to 1; members count by the weight
    of their vote for the role's class: ``role, feature, importance, rank``.
    """
    tables = []
    for number, role, part in parts:
        mean = part.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"))
        tables.append(mean.select(F.lit(number).alias("member"), F.lit(role).alias("role"), "feature", "mean_abs", "mean", F.lit(float(champion.weights[number][ROLES[role]])).alias("weight")))
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    whole = checkpointed(whole)
    return whole, consensus(whole)


def consensus(importances: DataFrame) -> DataFrame:
    """Importance of features over members: shares within a member, weighted by its vote; ``role, feature, importance, rank``."""
    one = Window.partitionBy("role", "member")  # features of one model
    shared = importances.withColumns({"_total": F.sum("mean_abs").over(one), "_w": F.col("weight")})
    weights = importances.select("role", "member", "weight").distinct().groupBy("role").agg(F.sum("weight").alias("_all"))
    share = F.when(F.col("_total") > 0, F.col("mean_abs") / F.col("_total")).otherwise(0.0)
    out = shared.join(F.broadcast(weights), "role").groupBy("role", "feature").agg(F.sum(share * F.col("_w") / F.col("_all")).alias("importance"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(F.round("importance", 12).desc(), "feature")))  # a row for each feature


def local_examples(predicted: DataFrame) -> DataFrame:
    """The first subject of each class that was predicted right: ``klass, subject``.  A class without one has no row."""
    right = predicted.filter("y = predicted").groupBy(F.col("y").alias("klass")).agg(F.min("subject").alias("subject"))
    return right.select("klass", "subject")


# ---- new recordings --------------------------------------------------------


def predict_wide(champion: Champion, wide: DataFrame, names: Sequence[str] = ("CN", "MCI", "DEM")) -> DataFrame:
    """Classes of subjects from a table of features, a column each: ``subject, p0, p1, p2, predicted`` by name.

    Features are taken by name in the champion's order; one that is missing is an error.
    """
    lacking = sorted(set(champion.features) - set(wide.columns))
    if lacking:
        raise ValueError(f"missing features: {lacking[:5]}")
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in champion.features])
    said = champion.predict(wide.select("subject", F.lit(-1).alias("y"), x.alias("x")))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("predicted") + 1)
    return said.select("subject", "p0", "p1", "p2", label.alias("predicted"))


def predict_recordings(spark: SparkSession, champion: Champion, activity: str | Sequence[str], sleep: str | Sequence[str], least: int = 7, zone: str = "Asia/Seoul") -> DataFrame:
    """From two CSV recordings to classes: ``subject, observed_days, p0, p1, p2, predicted``.

    No labels are read.  Subjects with fewer than ``least`` days are left out.
    """
    from ..sources import wearables as w

    days = {n: w.subject_days(w.read_recording(spark, path, w.RECORDINGS[n]), w.RECORDINGS[n], zone)[0] for n, path in (("activity", activity), ("sleep", sleep))}
    seen = days["activity"].select("subject", "date").union(days["sleep"].select("subject", "date")).groupBy("subject").agg(F.count_distinct("date").alias("observed_days"))
    wide, _ = w.subject_features(days["activity"], days["sleep"], least)
    return predict_wide(champion, wide).join(seen, "subject").select("subject", "observed_days", "p0", "p1", "p2", "predicted")
