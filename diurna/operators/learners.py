"""Classifiers, resampling and explanations on ``subject, y, features`` tables.

Models of Spark's own library, and some that need no more than sums: here
boosting goes one class against the rest and kernels through random Fourier
features; ``trees`` and ``kernels`` have the whole ones.  Everything learned is
a few vectors; rows stay on the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import softmax
from .areas import BLOCKS, blocks, mean_auc, packed, runs, stretches
from .folds import hash_int
from .lineage import checkpointed, shuffles_removed
from .search import FAILURES
from .trees import scored

K = 3


def vectors(long: DataFrame, features: Sequence) -> DataFrame:
    """Long form to one vector for each subject; features in the given order.

    A missing value becomes 0, the centre of scaled features; models that take
    missing values are in ``trees``.
    """
    wide = long.groupBy("subject", "y").pivot("feature", list(features)).agg(F.first("value"))
    array = F.array(*[F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) for f in features])
    return wide.select("subject", "y", array_to_vector(array).alias("features"))


def logistic(c: float = 1.0, weights: str | None = None, total_weight: float = 1.0) -> Callable:
    """L2 logistic regression with an inverse strength ``c``."""
    model = LogisticRegression(labelCol="y", regParam=1.0 / (c * total_weight), elasticNetParam=0.0, standardization=False, family="multinomial", maxIter=100)
    return (model.setWeightCol(weights) if weights else model).fit


def forest(trees: int = 50, depth: int = 6) -> Callable:
    return RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=7).fit


def boosted(trees: int = 20, depth: int = 3) -> Callable:
    return OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=7), labelCol="y").fit


def class_scores(fit: Callable, train: DataFrame, test: DataFrame) -> DataFrame:
    """Fit on one table, score another: ``subject, y, p0, p1, p2``."""
    model = fit(train)
    if hasattr(model, "proba"):
        return scored(test, model.proba, K)
    out = model.transform(test)
    if "probability" in out.columns:
        p = vector_to_array("probability")
        return out.select("subject", "y", *[p[k].alias(f"p{k}") for k in range(K)])
    raw = vector_to_array("rawPrediction")
    return out.select("subject", "y", *[c.alias(f"p{k}") for k, c in enumerate(softmax([raw[k] for k in range(K)]))])


def out_of_fold(fit: Callable, data: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """Every subject's scores by the model that hasn't seen it, a row each.

    Subjects without a fold, or with two, are an error.  Rows and their folds
    are written once, so no fit computes them again.
    """
    dealt = folds.groupBy("subject").agg(F.min("fold").alias("fold"), F.count(F.lit(1)).alias("_n"))
    rows = data.join(dealt, "subject", "left")
    sure = F.when((F.col("_n") == 1) & F.col("fold").between(0, k - 1), F.col("fold")).otherwise(F.raise_error(F.concat(F.lit("no single fold for "), F.col("subject").cast("string"))).cast("int"))
    rows = checkpointed(rows.withColumn("fold", sure).drop("_n"))  # read by every fold's fit
    parts = None
    for f in range(k):
        part = class_scores(fit, rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)).withColumn("fold", F.lit(f))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _summed(arrays: DataFrame, size: int) -> np.ndarray:
    """The sum of one array a row, made on the cluster place by place."""
    out = np.zeros(size)
    for r in arrays.select(F.posexplode(arrays.columns[0]).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator():
        out[r["i"]] = r["x"]
    return out


def discriminant_weights(train: DataFrame, shrinkage: float = 0.1, balance: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and constants, by class, of linear discriminants from class means and a shrunken pooled covariance.

    Priors are class counts ** (1 - balance).  Second moments are summed on the
    cluster, from one matrix for each task, number by number; d numbers squared
    reach the driver.
    """
    d = len(train.first()["features"])

    def moments(batches):
        n, s, ss = np.zeros(K), np.zeros((K, d)), np.zeros((d, d))
        for part in batches:
            x = np.stack([np.asarray(v) for v in part["x"]]) if len(part) else np.zeros((0, d))
            y = part["y"].to_numpy()
            ss += x.T @ x
            for k in range(K):
                n[k] += (y == k).sum()
                s[k] += x[y == k].sum(0)
        import pandas as pd

        yield pd.DataFrame({"all": [np.concatenate([n, s.ravel(), ss.ravel()]).tolist()]})

    arrays = train.select("y", vector_to_array("features").alias("x"))
    sums = _summed(arrays.mapInPandas(moments, "all array<double>"), K + K * d + d * d)
    n, s, ss = sums[:K], sums[K : K + K * d].reshape(K, d), sums[K + K * d :].reshape(d, d)
    means = s / n[:, None]
    within = (ss - (means.T * n) @ means) / n.sum()
    within = (1 - shrinkage) * within + shrinkage * np.trace(within) / d * np.eye(d)
    w = np.linalg.solve(within, means.T).T
    prior = n ** (1 - balance)
    return w, np.log(prior / prior.sum()) - 0.5 * (w * means).sum(1)


def discriminant(train: DataFrame, shrinkage: float = 0.1, balance: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """Scores by linear discriminants learned from ``train``."""
    w, b = discriminant_weights(train, shrinkage, balance)

    def score(test: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        z = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w[k]]), lambda a, c: a * c), F.lit(float(b[k])), lambda t, v: t + v) for k in range(K)]
        return test.select("subject", "y", *[c.alias(f"p{k}") for k, c in enumerate(softmax(z))])

    score.proba = LinearScore(w, b, _shares)
    return score


def _shares(z: np.ndarray, axis: int) -> np.ndarray:
    """Softmax of scores, with the classes along ``axis``."""
    e = np.exp(z - z.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def fourier_features(data: DataFrame, gamma: float, components: int = 64, seed: int = 7) -> DataFrame:
    """Random Fourier features: their products approach exp(-gamma |x - y|^2)."""
    d = len(data.first()["features"])
    rng = np.random.default_rng(seed)
    w, phase = rng.normal(0, np.sqrt(2 * gamma), (components, d)), rng.uniform(0, 2 * np.pi, components)

    @F.pandas_udf("array<double>")
    def lift(x):
        import pandas as pd

        z = np.sqrt(2 / components) * np.cos(np.stack(x.to_list()) @ w.T + phase)
        return pd.Series(list(z))

    return data.select("subject", "y", array_to_vector(lift(vector_to_array("features"))).alias("features"))


def kernel_machine(train: DataFrame, gamma: float = 0.01) -> Callable[[DataFrame], DataFrame]:
    """A max-margin machine over Fourier features, one class against the rest."""
    lifted = fourier_features(train, gamma).persist()  # read by every step of three fits
    model = OneVsRest(classifier=LinearSVC(maxIter=15, regParam=0.01), labelCol="y", parallelism=K).fit(lifted)
    lifted.unpersist()

    def score(test: DataFrame) -> DataFrame:
        raw = vector_to_array("rawPrediction")
        out = model.transform(fourier_features(test, gamma))
        return out.select("subject", "y", *[c.alias(f"p{k}") for k, c in enumerate(softmax([raw[k] for k in range(K)]))])

    return score


def kernel_ridge(train: DataFrame, gamma: float = 0.01, strength: float = 1.0, components: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Ridge regression on one-hot classes over Fourier features, put through softmax(3 x).

    One pass: products of the lifted rows and their class sums are added up on
    the cluster; ``components`` numbers squared reach the driver.
    """
    c = components

    def products(batches):
        import pandas as pd

        zz, zy = np.zeros((c, c)), np.zeros((c, K))
        for part in batches:
            if len(part):
                z = np.stack([np.asarray(v) for v in part["z"]])
                zz += z.T @ z
                zy += z.T @ np.eye(K)[part["y"].to_numpy()]
        yield pd.DataFrame({"all": [np.concatenate([zz.ravel(), zy.ravel()]).tolist()]})

    lifted = fourier_features(train, gamma, c).select("y", vector_to_array("features").alias("z"))
    sums = _summed(lifted.mapInPandas(products, "all array<double>"), c * c + c * K)
    w = np.linalg.solve(sums[: c * c].reshape(c, c) + strength * np.eye(c), sums[c * c :].reshape(c, K))

    def score(test: DataFrame) -> DataFrame:
        z = vector_to_array("features")
        said = [3 * F.aggregate(F.zip_with(z, F.array(*[F.lit(float(v)) for v in w[:, k]]), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) for k in range(K)]
        return fourier_features(test, gamma, c).select("subject", "y", *[p.alias(f"p{k}") for k, p in enumerate(softmax(said))])

    return score


def principal_components(data: DataFrame, k: int) -> DataFrame:
    """First ``k`` components of centred vectors; signs are arbitrary."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(data).transform(data)
    return PCA(k=k, inputCol="centred", outputCol="pca").fit(centred).transform(centred).select("subject", "y", F.col("pca").alias("features"))


def eliminate_features(long: DataFrame, ranked: Sequence, k: int, step: float = 0.2, c: float = 0.1) -> list:
    """Recursive elimination: drop the fifth of least absolute coefficients, refit."""
    left = list(ranked)
    while len(left) > k:
        data = vectors(long, left)
        model = logistic(c)(data)
        size = np.abs(model.coefficientMatrix.toArray()).sum(0)
        drop = max(1, min(len(left) - k, int(len(left) * step)))
        gone = set(np.argsort(size, kind="stable")[:drop].tolist())
        left = [f for i, f in enumerate(left) if i not in gone]
    return left


#: Blocks of a class, as long as they hold what a task can.
SPLITS = 16


def _nearest(own: np.ndarray, x: np.ndarray, ids: np.ndarray, z: np.ndarray, zz: np.ndarray, k: int):
    """The ``k`` rows of ``z``, at most, that are nearest to each of ``x``: ``subject, neighbour, distance``."""
    import pandas as pd

    xx = (x**2).sum(1)[:, None]
    d = xx + zz - 2 * x @ z.T
    d[own[:, None] == ids[None, :]] = np.inf
    last = np.partition(d, k - 1, 1)[:, k - 1 : k] if len(ids) > k else np.full((len(x), 1), np.inf)
    i, j = np.nonzero((d <= last + 1e-11 * (xx + zz.max())) & np.isfinite(d))  # more than k where products can't tell
    far = np.concatenate([np.sqrt(((x[i[s : s + 65536]] - z[j[s : s + 65536]]) ** 2).sum(1)) for s in range(0, len(i), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[j], far, i))
    i, j, far = i[order], j[order], far[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return pd.DataFrame({"subject": own[i], "neighbour": ids[j], "distance": far})[place < k]


def neighbours(data: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """The ``k`` nearest of the same class: ``subject, y, neighbour, distance``.

    Classes are cut into hash blocks; block meets block in a task, which keeps
    the best ``k`` of each row, so no pair leaves a task but those.  A class
    has up to ``SPLITS`` blocks of ``block`` rows or more, so rows are sent as
    often whatever their number; beyond 32 ``block`` rows a block, a task's
    memory has its limit, and blocks become more.

    Products of matrices find those that may be near; their distances are then
    taken from differences.  Ties go to the least neighbour.
    """
    size = F.count(F.lit(1))
    n = data.groupBy("y").agg(F.greatest(F.lit(1), F.least(F.lit(SPLITS), F.ceil(size / block)), F.ceil(size / (32 * block))).cast("int").alias("blocks"))
    rows = data.join(F.broadcast(n), "y").select("subject", "y", vector_to_array("features").alias("x"), "blocks", F.pmod(F.xxhash64("subject"), F.col("blocks")).cast("int").alias("own"))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("subject", "y", "x", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks")).unionByName(
        pairs.select("subject", "y", "x", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))
    )

    def best(key, part):
        import pandas as pd

        a, b = part[part.asks], part[~part.asks]
        if not len(a) or not len(b):
            return pd.DataFrame({"subject": [], "y": [], "neighbour": [], "distance": []})
        b = b.sort_values("subject")
        x, z, own, ids = np.stack(a.x.to_list()), np.stack(b.x.to_list()), a.subject.to_numpy(), b.subject.to_numpy()
        zz = (z**2).sum(1)
        out = [_nearest(own[s : s + 256], x[s : s + 256], ids, z, zz, k) for s in range(0, len(x), 256)]
        return pd.concat(out).assign(y=key[0])[["subject", "y", "neighbour", "distance"]]

    found = pairs.groupBy("y", "i", "j").applyInPandas(best, "subject long, y int, neighbour long, distance double")
    top = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k)
    return found.groupBy("subject", "y").agg(F.posexplode(top).alias("rank", "n")).select("subject", "y", "rank", F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance"))


def oversample(data: DataFrame, seed: int, k: int = 5) -> DataFrame:
    """New rows between a case and a near one of its class, until classes are equal.

    Returns ``y, parent, neighbour, features``; which case, neighbour and place
    between them are hashes, so parents are training subjects by construction.
    """
    data = checkpointed(data)
    n = data.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    lack = n.join(F.broadcast(n.agg(F.max("n").alias("most")))).filter("n < most").select("y", (F.col("most") - F.col("n")).alias("lack"), "n")
    from .folds import digest
    from .ranking import hash_rank

    ranked = hash_rank(data.withColumn("_d", digest(F.lit(seed), F.col("subject"))), ["y"], "_d")
    draws = lack.select("y", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lack"))).alias("i"))
    draws = draws.select("y", "i", (hash_int(F.lit(seed), F.col("y"), F.col("i")) % F.col("n") + 1).alias("rank"))
    near = neighbours(data, k).groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
    parent = draws.join(ranked.select("y", "rank", "subject", "features"), ["y", "rank"]).join(near, "subject")
    pick = F.get("near", (hash_int(F.lit(seed + 1), F.col("y"), F.col("i")) % F.size("near")).cast("int"))["neighbour"]
    parent = parent.select("y", "i", F.col("subject").alias("parent"), F.col("features").alias("a"), pick.alias("neighbour"))
    both = parent.join(data.select(F.col("subject").alias("neighbour"), F.col("features").alias("b")), "neighbour")
    t = hash_int(F.lit(seed + 2), F.col("y"), F.col("i")) / F.lit(float(1 << 48))
    mixed = F.zip_with(vector_to_array("a"), vector_to_array("b"), lambda x, z: x + t * (z - x))
    return both.select("y", "parent", "neighbour", mixed.alias("features"))


#: Scores that are on their way in shuffles at once, about (8 bytes each): repeats go in waves.
SENT = 1 << 27
#: Rows that a task deals and scores at once, about.
DEALT = 1 << 15


def permutation_importance(
    scored: Callable[[DataFrame], DataFrame], long: DataFrame, features: Sequence, repeats: int, seed: int, groups: dict[str, Sequence] | None = None
) -> DataFrame:
    """Macro AUC lost when a feature's values are dealt anew among subjects.

    With ``groups`` the features of each named group are dealt together, and
    ``feature`` holds the group's name.

    A permutation is a join on ranks: of subjects in one hash order and of
    donors in another.  Where ``scored`` has a ``proba``, a function of
    matrices, a task deals and scores its rows for all features, a matrix at a
    time, and only packed scores are shuffled; of a ``LinearScore`` only the
    dealt features' products are computed anew.  Else all permuted tables are
    scored in one plan, in which ``subject`` is a struct of the subject and the
    number of the feature and repeat.

    Repeats go in waves of about ``SENT`` scores, one repeat at least, and a
    wave's shuffles are removed before the next: disk grows with the rows, not
    with rows times repeats.
    """
    from .folds import digest
    from .ranking import hash_rank

    data = vectors(long, features).select("subject", "y", vector_to_array("features").alias("x"))
    data = checkpointed(data)
    n = data.count()
    parts = stretches(n)
    sets = {f: [f] for f in features} if groups is None else groups
    place = {f: i for i, f in enumerate(features)}
    places = [[place[f] for f in own] for own in sets.values()]
    proba = getattr(scored, "proba", None)

    def changed(x, z):
        """The matrix of shares of each set, a row a class."""
        if isinstance(proba, LinearScore):
            base, gain = proba.weights @ x.T + proba.constants[:, None], (z - x).T
            for own in places:
                yield proba.link(base + proba.weights[:, own] @ gain[own], 0)
            return
        mixed = x.copy()
        for own in places:
            mixed[:, own] = z[:, own]
            yield proba(mixed).T
            mixed[:, own] = x[:, own]

    def of_rows(held):
        t = pa.Table.from_batches(held).combine_chunks()
        repeat, y = t.column("repeat").to_numpy(), t.column("y").to_numpy()
        order = np.lexsort((y, repeat))
        repeat, y = repeat[order], y[order]
        x, z = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)[order] for c in ("x", "z"))
        first = np.flatnonzero(np.diff(repeat, prepend=-1) | np.diff(y, prepend=-1))
        for i, p in enumerate(changed(x, z)):
            if parts == 1:
                yield runs(i * repeats + repeat, y, p, first)
            else:
                yield from blocks(i * repeats + repeat, y, p.T, parts)

    def permuted(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= DEALT:
                yield from of_rows(held)
                held, rows = [], 0
        if rows:
            yield from of_rows(held)

    def said(rows: DataFrame) -> DataFrame:
        return packed(scored(rows).select(F.col("subject.key").alias("key"), "y", "p0", "p1", "p2"), n)

    def wave(first: int, last: int) -> DataFrame:
        """Mean areas by feature and repeat."""
        turns = data.select("subject", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("repeat"))
        a = hash_rank(turns.withColumn("_d", digest(F.lit(seed), F.col("repeat"), F.col("subject"))), ["repeat"], "_d").select("repeat", "rank", "subject")
        c = hash_rank(turns.withColumn("_d", digest(F.lit(seed + 1), F.col("repeat"), F.col("subject"))), ["repeat"], "_d").select("repeat", "rank", F.col("subject").alias("donor"))
        dealt = a.join(c, ["repeat", "rank"]).join(data, "subject").join(data.select(F.col("subject").alias("donor"), F.col("x").alias("z")), "donor")
        if proba is not None:
            some = dealt.select("repeat", F.col("y").cast("int").alias("y"), "x", "z").mapInArrow(permuted, BLOCKS)
        else:
            at = dealt.select("*", F.posexplode(F.array(*[F.array(*[F.lit(p) for p in own]) for own in places])).alias("i", "own"))
            mixed = F.transform("x", lambda v, i: F.when(F.array_contains("own", i), F.get("z", i)).otherwise(v))
            some = said(at.select(F.struct("subject", (F.col("i") * repeats + F.col("repeat")).alias("key")).alias("subject"), "y", array_to_vector(mixed).alias("features")))
        return checkpointed(mean_auc(some))  # a row for each feature and repeat

    base = mean_auc(said(data.select(F.struct("subject", F.lit(0).alias("key")).alias("subject"), "y", array_to_vector("x").alias("features")))).first()["auc"]
    waves = min(repeats, -(-n * K * len(sets) * repeats // SENT)) or 1
    cuts = [repeats * w // waves for w in range(waves + 1)]
    with shuffles_removed(long.sparkSession):
        drops = reduce(DataFrame.unionByName, [wave(first, end - 1) for first, end in zip(cuts, cuts[1:], strict=False)])
    name = F.get(F.array(*[F.lit(s) for s in sets]), F.floor(F.col("key") / repeats).cast("int"))
    return drops.select(name.alias("feature"), (F.col("key") % repeats).alias("repeat"), (F.lit(base) - F.col("auc")).alias("drop"))


def vector_correlations(data: DataFrame, features: Sequence) -> DataFrame:
    """Pearson r of all pairs of features, a before b: one matrix of products for each task."""
    d = len(features)
    rows = data.select(vector_to_array("features").alias("x"))
    centre = np.array(rows.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(d)]).first(), float)

    def products(batches):
        import pandas as pd

        out = np.zeros((d, d))
        for part in batches:
            if len(part):
                x = np.stack([np.asarray(v) for v in part["x"]]) - centre
                out += x.T @ x
        yield pd.DataFrame({"ss": [out.ravel().tolist()]})

    total = _summed(rows.mapInPandas(products, "ss array<double>"), d * d).reshape(d, d)
    scale = np.sqrt(np.diag(total))
    pairs = [(features[i], features[j], float(total[i, j] / (scale[i] * scale[j])) if scale[i] and scale[j] else None) for i in range(d) for j in range(i + 1, d)]
    return data.sparkSession.createDataFrame(pairs, "a int, b int, r double")


def linear_contributions(data: DataFrame, coefficients: Sequence[float], means: Sequence[float]) -> DataFrame:
    """Shapley values of a linear score: coefficient times distance from the mean."""
    x = vector_to_array("features")
    w, m = (F.array(*[F.lit(float(v)) for v in s]) for s in (coefficients, means))
    phi = F.zip_with(F.zip_with(x, m, lambda a, c: a - c), w, lambda a, c: a * c)
    return data.select("subject", F.posexplode(phi).alias("feature", "contribution"))


#: Rows that stand for a missing feature, at most.
BACKGROUND = 80


def background_rows(data: DataFrame, seed: int, n: int = BACKGROUND) -> np.ndarray:
    """``n`` rows of features, at most, chosen by a hash of the subject."""
    rows = data.select(hash_int(F.lit(seed), F.col("subject")).alias("h"), "subject", vector_to_array("features").alias("x"))
    return np.array([r["x"] for r in rows.orderBy("h", "subject").limit(n).collect()], float)


@dataclass(frozen=True)
class LinearScore:
    """Scores that are a function of ``x @ weights.T + constants``: ``link(z, axis)``, with the classes along ``axis``."""

    weights: np.ndarray
    constants: np.ndarray
    link: Callable[[np.ndarray, int], np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.link(x @ self.weights.T + self.constants, 1)


#: Subjects whose contributions a task sends at once.
EXPLAINED = 256


def shapley_values(data: DataFrame, score: Callable[[np.ndarray], np.ndarray], background: np.ndarray, seed: int, rounds: int = 1) -> DataFrame:
    """Shapley values from permutations: ``subject, feature, klass, contribution``.

    ``score`` maps rows of features to a row of figures, one a class.  In each
    round a subject's features join the background rows in a random order and
    then in its reverse; what the mean score gains at a feature is its part.
    Parts add up to the subject's score less the background's mean score.  The
    order comes from the subject and the round, so a task run again agrees.
    Of a ``LinearScore`` a feature that joins adds its own products only, so
    all steps of an order are running sums; other scores are computed anew at
    each step.
    """
    d = background.shape[1]

    def by_steps(x, turn, base):
        mixed = background.copy()
        means = np.empty((d, len(base)))
        for i, f in enumerate(turn):
            mixed[:, f] = x[f]
            means[i] = score(mixed).mean(0)
        return means

    def by_sums(x, turn, base):
        # steps, classes, background rows
        z = ((x - background).T[turn])[:, None, :] * score.weights.T[turn][:, :, None]
        z[0] += (background @ score.weights.T + score.constants).T
        return score.link(np.cumsum(z, 0, out=z), 1).mean(2)

    steps = by_sums if isinstance(score, LinearScore) else by_steps

    def explain(batches):
        import pandas as pd

        base = score(background).mean(0)
        k = len(base)
        for whole in batches:
            for at in range(0, len(whole), EXPLAINED):
                part = whole.iloc[at : at + EXPLAINED]
                phi = np.zeros((len(part), d, k))
                for own, subject, x in zip(phi, part["subject"], part["x"], strict=True):
                    x = np.asarray(x, float)
                    for r in range(rounds):
                        order = np.random.default_rng([seed, r, abs(int(subject)), int(subject < 0)]).permutation(d)
                        for turn in (order, order[::-1]):
                            own[turn] += np.diff(steps(x, turn, base), axis=0, prepend=base[None])
                phi /= 2 * rounds
                n = len(part)
                yield pd.DataFrame({"subject": np.repeat(part["subject"].to_numpy(), d * k), "feature": np.tile(np.repeat(np.arange(d), k), n), "klass": np.tile(np.arange(k), d * n), "contribution": phi.ravel()})

    rows = data.select(F.col("subject").cast("long").alias("subject"), vector_to_array("features").alias("x"))
    return rows.mapInPandas(explain, "subject long, feature int, klass int, contribution double")


#: Families that a search draws from, and the ranges of what it draws: on a log scale, or whole numbers.
SPACES: dict[str, dict[str, tuple[str, float, float]]] = {
    "logistic": {"c": ("log", 1e-3, 10.0)},
    "forest": {"trees": ("int", 5, 40), "depth": ("int", 2, 8)},
    "boosted": {"trees": ("int", 5, 20), "depth": ("int", 2, 4)},
}
FAMILIES: dict[str, Callable] = {"logistic": logistic, "forest": forest, "boosted": boosted}


def drawn_parameters(family: str, trial: int, seed: int) -> dict[str, float]:
    """What trial number ``trial`` of a family tries; a family has ranges of its own."""
    rng = np.random.default_rng([seed, trial, *family.encode()])
    out: dict[str, float] = {}
    for name, (kind, low, high) in SPACES[family].items():
        out[name] = float(np.exp(rng.uniform(np.log(low), np.log(high)))) if kind == "log" else int(rng.integers(int(low), int(high) + 1))
    return out


def parameter_search(data: DataFrame, folds: DataFrame, k: int, families: Sequence[str], trials: int, seed: int, done: DataFrame | None = None) -> DataFrame:
    """Random search: ``family, trial, parameters, status, macro_recall, log_loss, error``.

    Each trial is scored out of fold.  One that fails is a row with its error,
    not the end of the search.  Trials in ``done``, a table of an earlier
    search, aren't run again and are part of the result, so a search that was
    cut short goes on where it stopped.
    """
    import json

    from .metrics import log_loss

    spark = data.sparkSession
    schema = "family string, trial int, parameters string, status string, macro_recall double, log_loss double, error string"
    known = set() if done is None else {(r["family"], r["parameters"]) for r in done.select("family", "parameters").collect()}
    rows = []
    for family in families:
        for t in range(trials):
            values = drawn_parameters(family, t, seed)
            text = json.dumps(values, sort_keys=True)
            if (family, text) in known:
                continue
            try:
                said = out_of_fold(FAMILIES[family](**values), data, folds, k)
                top = F.greatest("p0", "p1", "p2")
                hit = F.when(F.col("y") == 0, F.col("p0")).when(F.col("y") == 1, F.col("p1")).otherwise(F.col("p2")) == top
                n, losses = F.count(F.lit(1)).alias("n"), log_loss(said).alias("loss")
                figures = said.groupBy("y").agg(F.avg(hit.cast("double")).alias("recall"), n, losses).agg(F.avg("recall"), F.sum(F.col("loss") * F.col("n")) / F.sum("n")).first()
                rows.append((family, t, text, "done", float(figures[0]), float(figures[1]), None))
            except FAILURES as e:  # such a trial is a result; any other error ends the search
                rows.append((family, t, text, "failed", None, None, f"{type(e).__name__}: {e}"[:500]))
    new = spark.createDataFrame(rows, schema)
    return new if done is None else done.select(*new.columns).unionByName(new)


def greedy_ensemble(scores: DataFrame, models: Sequence, steps: int = 8, members: int = 4, least: float = 1e-7) -> list:
    """Forward selection with replacement by macro recall, then log loss.

    ``scores``: ``subject, y, model, p0, p1, p2``.  Each step is one aggregate
    over all candidates at once.
    """
    chosen: list = []
    best = None
    while len(chosen) < steps:
        options = [m for m in models if m in chosen or len(set(chosen)) < members]
        use = F.create_map(*[x for m in options for x in (F.lit(m), F.array(*[F.lit(float((chosen + [m]).count(n))) for n in models]))])
        place = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])
        rows = scores.withColumn("candidate", F.explode(F.array(*[F.lit(m) for m in options])))
        rows = rows.withColumn("w", F.get(use[F.col("candidate")], place[F.col("model")]))
        mixed = rows.groupBy("candidate", "subject", "y").agg(*[(F.sum(F.col("w") * F.col(f"p{k}")) / F.sum("w")).alias(f"p{k}") for k in range(K)])
        top = F.greatest("p0", "p1", "p2")
        hit = F.when(F.col("y") == 0, F.col("p0")).when(F.col("y") == 1, F.col("p1")).otherwise(F.col("p2")) == top
        by = mixed.groupBy("candidate", "y").agg(F.avg(hit.cast("double")).alias("recall"))
        table = {r["candidate"]: r["m"] for r in by.groupBy("candidate").agg(F.avg("recall").alias("m")).collect()}
        pick = max(options, key=lambda m: (round(table[m], 12), -list(models).index(m)))
        if best is not None and table[pick] <= best + least:
            break
        best = table[pick]
        chosen.append(pick)
    return chosen

