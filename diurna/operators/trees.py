"""Trees grown on the cluster: boosting on histograms, and extremely randomised trees.

Rows are ``subject, y, weight, x``: ``x`` an array of numbers, where null and NaN
are missing.  A tree is grown node by node from sums that tasks make over their
rows and Spark adds up: gradients by bin for boosting, ends and class counts for
random thresholds.  What reaches the driver is a row for each node, or for each
node and candidate: it grows with the model, never with the data.

A row without any weight column counts 1.  Rows with a null class are an error,
as are rows of unequal numbers of features.  An empty table is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

#: Numbers that a task holds at once of a matrix of rows and features.
CELLS = 1 << 20
#: Rounds of boosting after which scores so far are written, so that plans and routes stay short.
WRITE_EVERY = 8
#: Cuts of a feature's values between which they are counted before bins are cut.
CUTS = 512


@dataclass
class Tree:
    """Nodes of one tree, root first.  ``feature`` is -1 in leaves; ``value`` has a row for each node."""

    feature: np.ndarray
    threshold: np.ndarray
    cut: np.ndarray  # bin of the threshold; unused where there are no bins
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # weight of training rows

    def leaves(self, column: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], rows: int, by_bin: bool = False) -> np.ndarray:
        """The leaf of each row; ``column(rows, features)`` gives values and which are missing."""
        node = np.zeros(rows, np.int64)
        limit = self.cut if by_bin else self.threshold
        todo = np.arange(rows) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(todo):
            at = node[todo]
            v, missing = column(todo, self.feature[at])
            with np.errstate(invalid="ignore"):
                goes_left = np.where(missing, self.missing_left[at], v <= limit[at])
            node[todo] = np.where(goes_left, self.left[at], self.right[at])
            todo = todo[self.feature[node[todo]] >= 0]
        return node


def _of(x: np.ndarray):
    """Access to a matrix of numbers, NaN where missing."""

    def column(rows, features):
        v = x[rows, features]
        return v, np.isnan(v)

    return column


def _of_bins(b: np.ndarray):
    """Access to a matrix of bins, 0 where missing."""

    def column(rows, features):
        v = b[rows, features]
        return v, v == 0

    return column


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix; nulls become NaN, unequal lengths an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a row has no features")
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"rows of unequal numbers of features: {lengths[:5].tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a matrix of ``width`` columns has ``CELLS`` numbers at most."""
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rows_of(data: DataFrame) -> DataFrame:
    """``subject, y, weight, x``, with weight 1 where there is none."""
    weight = F.col("weight").cast("double") if "weight" in data.columns else F.lit(1.0)
    y = F.when(F.col("y").isNull(), F.raise_error(F.lit("a row has no class")).cast("int")).otherwise(F.col("y").cast("int"))
    return data.select("subject", y.alias("y"), weight.alias("weight"), F.col("x").cast("array<double>").alias("x"))


# ---- bins ----------------------------------------------------------------


def _sorted_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Each part's values by feature, ascending, missing ones left out; shorter rows lack their last features."""
    for batch in batches:
        for part in _parts([batch], np.diff(batch.column("x").offsets.to_numpy()).max(initial=1)):
            column = part.column("x")
            lengths = np.diff(column.offsets.to_numpy())
            x = np.full((part.num_rows, lengths.max(initial=0)), np.nan)
            x[np.arange(x.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(float) + 0.0  # no -0.0
            columns = np.sort(np.ascontiguousarray(x.T), 1)  # NaN last
            yield [v[:m] for v, m in zip(columns, (~np.isnan(columns)).sum(1), strict=True)]


def _record(names: Sequence[str], kinds: Sequence[pa.DataType], columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k.to_pandas_dtype()), *c]).astype(k.to_pandas_dtype()), k) for k, c in zip(kinds, columns, strict=True)], list(names))


def _cuts(rows: DataFrame) -> dict[int, np.ndarray]:
    """Up to ``CUTS`` values of each feature at about equal ranks: percentiles of every 64th value of sorted parts."""

    def run(batches):
        for columns in _sorted_columns(batches):
            some = [v[len(v) % 64 // 2 :: 64] for v in columns]
            yield _record(("feature", "value"), (pa.int32(), pa.float64()), [[np.full(len(v), f) for f, v in enumerate(some)], some])

    shares = [i / CUTS for i in range(1, CUTS)]
    found = rows.mapInArrow(run, "feature int, value double").groupBy("feature").agg(F.percentile_approx("value", shares, 10000).alias("cuts")).collect()  # numbers of features times cuts
    return {r["feature"]: np.unique(r["cuts"]) for r in found}


def _ends(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where each span of sorted values begins, and the end: span i holds values above cut i - 1 up to cut i."""
    return np.concatenate([[0], np.searchsorted(v, cuts, side="right"), [len(v)]])


def _counted(cuts: dict[int, np.ndarray]) -> Callable:
    """Rows, least and greatest value of each span, by task."""

    def run(batches):
        shape = max(cuts, default=-1) + 1, max(map(len, cuts.values()), default=0) + 1
        n, low, high = np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
        for columns in _sorted_columns(batches):
            for f, v in enumerate(columns):
                if not len(v):
                    continue
                at = _ends(v, cuts[f])
                held = np.flatnonzero(np.diff(at))
                n[f, held] += np.diff(at)[held]
                low[f, held] = np.minimum(low[f, held], v[at[held]])
                high[f, held] = np.maximum(high[f, held], v[at[held + 1] - 1])
        f, s = np.nonzero(n)
        yield _record(("feature", "span", "n", "low", "high"), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()), [[f], [s], [n[f, s]], [low[f, s]], [high[f, s]]])

    return run


def _listed(cuts: dict[int, np.ndarray], asked: dict[int, list[int]]) -> Callable:
    """The values of the spans asked for and how often each occurs, by part."""

    def run(batches):
        for columns in _sorted_columns(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for f, v in enumerate(columns):
                if not len(v) or f not in asked:
                    continue
                at = _ends(v, cuts[f])
                for s in asked[f]:
                    values, n = np.unique(v[at[s] : at[s + 1]], return_counts=True)
                    for o, c in zip(out, (np.full(len(n), f), np.full(len(n), s), values, n), strict=True):
                        o.append(c)
            yield _record(("feature", "span", "value", "n"), (pa.int32(), pa.int32(), pa.float64(), pa.int64()), out)

    return run


def bins(data: DataFrame, most: int = 63) -> DataFrame:
    """Bins of each feature: ``feature, bin, low, high, n, threshold``.

    A feature of at most ``most`` different values has a bin for each; another
    is cut into bins of equal ranks, where equal values share one.  Bin 0 is
    kept for missing values.  ``threshold``: the middle between a bin and the
    next, null after the last.

    Three passes, exact whatever the cuts: approximate cuts, counts of all
    values between them, and a list of the values of those spans in which a bin
    may end.  All others lie in one bin whole and are only counted.
    """
    rows = data.filter("x is not null").select(F.col("x").cast("array<double>").alias("x"))
    cuts = _cuts(rows)
    counted = rows.mapInArrow(_counted(cuts), "feature int, span int, n long, low double, high double")
    counted = counted.groupBy("feature", "span").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    one = Window.partitionBy("feature")  # at most CUTS rows
    before = F.coalesce(F.sum("n").over(one.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kinds = F.sum(F.when(F.col("low") < F.col("high"), 2).otherwise(1)).over(one)  # at least
    spans = counted.withColumns({"before": before, "total": F.sum("n").over(one), "many": kinds > most})
    bin_of = f"{{}} * {most} div total"
    asked = F.expr(f"low < high and (not many or {bin_of.format('before')} <> {bin_of.format('(before + n - 1)')})")
    spans = checkpointed(spans.withColumn("asked", asked))

    open_spans: dict[int, list[int]] = {}
    for r in spans.filter("asked").select("feature", "span").collect():  # of a feature of many values `most` at most
        open_spans.setdefault(r["feature"], []).append(r["span"])
    values = rows.mapInArrow(_listed(cuts, open_spans), "feature int, span int, value double, n long").groupBy("feature", "span", "value").agg(F.sum("n").alias("n"))
    values = values.join(spans.select("feature", "span", "before", "total", "many"), ["feature", "span"])
    inside = Window.partitionBy("feature", "span").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    names = ("feature", "low", "high", "n", "before", "total", "many")
    cells = spans.filter("not asked").select(*names).unionByName(values.withColumns({"low": F.col("value"), "high": F.col("value")}).select(*names))
    cells = checkpointed(cells.withColumn("_at", F.expr(bin_of.format("before"))))

    # a feature not known to have many values has all of them listed
    few = cells.filter("not many").groupBy("feature").agg((F.count(F.lit(1)) <= most).alias("few"))
    cells = cells.join(few, "feature", "left").withColumn("_own", F.when(F.col("few"), F.col("low")))
    held = cells.groupBy("feature", F.when(F.col("_own").isNull(), F.col("_at")).alias("_at"), "_own").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    w = Window.partitionBy("feature").orderBy("low")  # at most `most` rows
    middle = (F.col("high") + F.lead("low").over(w)) / 2
    middle = F.when(middle >= F.lead("low").over(w), F.col("high")).otherwise(middle)
    return held.select("feature", F.row_number().over(w).alias("bin"), "low", "high", "n", middle.alias("threshold"))


def thresholds(table: DataFrame, features: int) -> list[np.ndarray]:
    """Ascending thresholds of each feature, from the table of bins: features times bins numbers."""
    out: list[list[float]] = [[] for _ in range(features)]
    for r in table.filter("threshold is not null").select("feature", "bin", "threshold").orderBy("feature", "bin").collect():
        out[r["feature"]].append(r["threshold"])
    return [np.array(t, float) for t in out]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each number: 0 if missing, else 1 and one more for each threshold below it."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left") + 1
    out[np.isnan(x)] = 0
    return out


# ---- boosting ------------------------------------------------------------


@dataclass
class Boosted:
    """A boosted model: ``trees[round][class]``; scores start at ``base``.  Two classes have one tree a round."""

    base: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _added(np.tile(self.base, (len(x), 1)), self.trees, _of(x), False)

    def proba(self, x: np.ndarray) -> np.ndarray:
        return probabilities(self.raw(x))


def _added(scores: np.ndarray, trees: list[list[Tree]], column, by_bin: bool) -> np.ndarray:
    for turn in trees:
        for k, tree in enumerate(turn):
            scores[:, k] += tree.value[tree.leaves(column, len(scores), by_bin)]
    return scores


def probabilities(raw: np.ndarray) -> np.ndarray:
    """Softmax of a row's scores; of a single one, the two classes' shares."""
    if raw.shape[1] == 1:
        raw = np.hstack([np.zeros_like(raw), raw])
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by each score."""
    p = probabilities(raw)
    if raw.shape[1] == 1:
        p = p[:, 1:]
        hit = (y == 1)[:, None]
    else:
        hit = y[:, None] == np.arange(raw.shape[1])
    return weight[:, None] * (p - hit), weight[:, None] * p * (1 - p)


def start(data: DataFrame, classes: int) -> np.ndarray:
    """Scores before the first tree: log shares of the classes by weight, or the log odds of the second of two."""
    found = {r["y"]: r["w"] for r in data.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    if set(found) != set(range(classes)):
        raise ValueError(f"classes {sorted(found)}, not 0 to {classes - 1}")
    w = np.array([found[k] for k in range(classes)], float)
    return np.log(w / w.sum()) if classes > 2 else np.log(w[1:] / w[0])


_SUMS = "slot int, feature int, bin int, n long, c double, g double, h double"


def histograms(state: DataFrame, features: int, trees: list[list[Tree]], open_trees: list[Tree], slots: list[dict[int, int]], width: int = 256) -> DataFrame:
    """Tasks' sums of rows, weights and derivatives by ``slot``, ``feature`` and ``bin``.

    ``state`` has bins and scores; ``trees`` are grown since they were written.
    ``slots[k]`` numbers the nodes of class k's open tree that are asked for.
    A task adds up its rows in one dense block, ``width`` bins for each feature
    and node, and emits the bins that hold any; sums of tasks are added later.
    """
    asked = sum(len(s) for s in slots)

    def run(batches):
        size = asked * features * width
        n, c, g_sum, h_sum = (np.zeros(size) for _ in range(4))
        top = 0
        for part in _parts(batches, features):
            b = np.frombuffer(b"".join(part.column("b").to_pylist()), np.uint8).reshape(part.num_rows, features)
            raw = _added(matrix_of(part.column("f")).copy(), trees, _of_bins(b), True)
            weight = part.column("weight").to_numpy()
            g, h = gradients(raw, part.column("y").to_numpy(), weight)
            for k, own in enumerate(slots):
                if not own:
                    continue
                number = np.full(len(open_trees[k].feature), -1)
                number[list(own)] = list(own.values())
                slot = number[open_trees[k].leaves(_of_bins(b), len(b), True)]
                rows = np.flatnonzero(slot >= 0)
                at = ((slot[rows, None] * features + np.arange(features)) * width + b[rows]).ravel()
                for sums, what in ((n, None), (c, weight[rows]), (g_sum, g[rows, k]), (h_sum, h[rows, k])):
                    got = np.bincount(at, None if what is None else np.repeat(what, features))
                    sums[: len(got)] += got
                    top = max(top, len(got))
        held = np.flatnonzero(n[:top])
        columns = [held // (width * features), held // width % features, held % width, n[held], c[held], g_sum[held], h_sum[held]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(t.to_pandas_dtype()), t) for v, t in zip(columns, kinds, strict=True)], ["slot", "feature", "bin", "n", "c", "g", "h"])

    return state.select("y", "weight", "b", "f").mapInArrow(run, _SUMS)


_SPLIT = "slot int, feature int, bin int, gain double, missing_left boolean, " + ", ".join(f"{side}_{s} {'long' if s == 'n' else 'double'}" for side in ("all", "left") for s in ("n", "c", "g", "h"))


def candidate_splits(sums: DataFrame, width: int, strength: float, least: int, least_h: float = 1e-3) -> DataFrame:
    """Best splits of each slot among the features of a partition: where rows go, and both sides' sums.

    ``sums`` are tasks' sums; those of a slot and feature meet in one
    partition, which adds them up as they come.  A split sends bins up to
    ``bin`` to the left, missing values to the side where the gain is greater;
    where a node has none, to the side of more rows.  Ties go to the first
    feature, then the first bin, then to missing values on the left.  A slot
    without a valid split has a null ``gain`` and its sums.
    """

    def run(batches):
        place: dict[int, int] = {}
        held = np.zeros((64, width, 4))
        for part in batches:
            key = part.column("slot").to_numpy().astype(np.int64) << 32 | part.column("feature").to_numpy()
            keys, which = np.unique(key, return_inverse=True)
            at = np.array([place.setdefault(int(k), len(place)) for k in keys], np.int64)
            if len(place) > len(held):
                held = np.concatenate([held, np.zeros((len(place), width, 4))])
            np.add.at(held, (at[which], part.column("bin").to_numpy()), np.stack([part.column(c).to_numpy() for c in ("n", "c", "g", "h")], 1))
        if not place:
            return
        keys = np.fromiter(place, np.int64)
        slot, feature = keys >> 32, keys & 0xFFFFFFFF
        sums = held[: len(keys)]
        whole = sums.sum(1)[:, None]  # node and feature, bin, side of missing values, sum
        upto = np.cumsum(sums[:, 1:], 1)
        left = np.stack([upto + sums[:, :1], upto], 2)
        right = whole[:, :, None] - left
        score = lambda x: x[..., 2] ** 2 / (x[..., 3] + strength)
        gain = score(left) + score(right) - score(whole[:, :, None])
        fits = (np.minimum(left[..., 0], right[..., 0]) >= least) & (np.minimum(left[..., 3], right[..., 3]) >= least_h) & (sums[:, 1:, None, 0] > 0)
        own = (sums[:, :1, None, 0] > 0) | ((left[..., 0] >= right[..., 0]) == np.array([True, False]))
        gain = np.where(fits & own & (gain > 0), gain, -np.inf)
        rows = []
        for s in np.unique(slot):
            mine = np.flatnonzero(slot == s)
            mine = mine[np.argsort(feature[mine])]  # the first of equal gains has the first feature, bin and side
            best = np.unravel_index(np.argmax(np.round(gain[mine], 9)), gain[mine].shape)
            r, b, side = mine[best[0]], best[1], best[2]
            found = gain[r, b, side] if np.isfinite(gain[r, b, side]) else None
            rows.append([int(s), int(feature[r]), int(b) + 1, found, side == 0, *whole[r, 0].tolist(), *left[r, b, side].tolist()])
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), *[pa.int64(), pa.float64(), pa.float64(), pa.float64()] * 2]
        names = ["slot", "feature", "bin", "gain", "missing_left", *(f"{side}_{c}" for side in ("all", "left") for c in ("n", "c", "g", "h"))]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) if k == pa.int64() else r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return sums.repartition("slot", "feature").mapInArrow(run, _SPLIT)


def best_splits(candidates: DataFrame) -> DataFrame:
    """One row for each slot: its best candidate."""
    first = F.struct(F.round(F.coalesce("gain", F.lit(-1.0)), 9), -F.col("feature"), -F.col("bin"), F.col("missing_left"))
    what = F.struct(*[c for c in candidates.columns if c != "slot"])
    return candidates.groupBy("slot").agg(F.max_by(what, first).alias("best")).select("slot", "best.*")


def _order(split) -> tuple:
    return (round(-1.0 if split["gain"] is None else split["gain"], 9), -split["feature"], -split["bin"], split["missing_left"])


class _Growing:
    """A tree whose nodes are split as far as their gains are known."""

    def __init__(self, edges: list[np.ndarray]) -> None:
        self.edges = edges
        self.nodes: list[dict] = [{"depth": 0}]

    def learn(self, node: int, found: dict) -> None:
        """Take a node's best split; its children are known by their sums only."""
        me = self.nodes[node]
        me["known"] = True
        if node == 0:
            me.update({s: found[f"all_{s}"] for s in ("n", "c", "g", "h")})
        if found["gain"] is None:
            return
        left = {s: found[f"left_{s}"] for s in ("n", "c", "g", "h")}
        right = {s: me[s] - left[s] for s in left}
        me.update(gain=found["gain"], feature=found["feature"], cut=found["bin"], missing_left=found["missing_left"], left=len(self.nodes), right=len(self.nodes) + 1)
        self.nodes += [side | {"depth": me["depth"] + 1} for side in (left, right)]

    def plan(self, leaves: int, depth: int, least: int) -> tuple[set[int], list[int]]:
        """Nodes to split, best gain first, and nodes that must be known before going on.

        While some are asked for, so are the children of the other best nodes,
        to save passes.
        """
        chosen: set[int] = set()
        frontier, ask = [0], []
        while len(chosen) < leaves - 1:
            ask = [i for i in frontier if "known" not in self.nodes[i] and self.nodes[i]["depth"] < depth and self.nodes[i].get("n", 2 * least) >= 2 * least]
            if ask:
                break
            able = [i for i in frontier if self.nodes[i].get("gain")]
            if not able:
                break
            best = min(able, key=lambda i: (-round(self.nodes[i]["gain"], 9), i))
            chosen.add(best)
            frontier.remove(best)
            frontier += [self.nodes[best]["left"], self.nodes[best]["right"]]
        if ask:
            more = sorted((i for i in frontier if self.nodes[i].get("gain")), key=lambda i: -self.nodes[i]["gain"])[: leaves - 1 - len(chosen)]
            for i in more:
                ask += [j for j in (self.nodes[i]["left"], self.nodes[i]["right"]) if "known" not in self.nodes[j] and self.nodes[j]["depth"] < depth and self.nodes[j]["n"] >= 2 * least]
        return chosen, ask

    def tree(self, split: set[int] | None, strength: float, rate: float) -> tuple[Tree, dict[int, int]]:
        """The tree that splits ``split`` (all that can be if None), and its nodes by their numbers here."""
        order, place = [0], {0: 0}
        for i in order:
            if (split is None or i in split) and self.nodes[i].get("gain"):
                for j in (self.nodes[i]["left"], self.nodes[i]["right"]):
                    place[j] = len(order)
                    order.append(j)
        inner = [(split is None or i in split) and bool(self.nodes[i].get("gain")) for i in order]
        nodes = [self.nodes[i] for i in order]

        def column(name, default, kind):
            return np.array([n[name] if s else default for n, s in zip(nodes, inner, strict=True)], kind)

        feature, cut = column("feature", -1, np.int64), column("cut", 0, np.int64)
        # beyond the last threshold a split tells present from missing
        limit = [np.inf if f < 0 or c > len(self.edges[f]) else self.edges[f][c - 1] for f, c in zip(feature, cut, strict=True)]
        value = np.array([-rate * n.get("g", 0.0) / (n.get("h", 0.0) + strength) for n in nodes])
        links = [np.array([place[n[side]] if s else -1 for n, s in zip(nodes, inner, strict=True)], np.int64) for side in ("left", "right")]
        return Tree(feature, np.array(limit, float), cut, column("missing_left", True, bool), *links, value, np.array([n.get("c", 0.0) for n in nodes])), place


def stump(value: float) -> Tree:
    """A tree of one leaf."""
    none = np.array([-1], np.int64)
    return Tree(none, np.array([np.inf]), np.zeros(1, np.int64), np.ones(1, bool), none, none, np.array([value]), np.zeros(1))


_STATE = "y int, weight double, b binary, f array<double>"


def encoded(rows: DataFrame, features: int, edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """Rows as boosting reads them: class, weight, a byte for each feature's bin, and scores at their start."""
    first = base.tolist()

    def run(batches):
        for part in _parts(batches, features):
            x = matrix_of(part.column("x"))
            if len(x) and x.shape[1] != features:
                raise ValueError(f"{x.shape[1]} features, not {features}")
            b = to_bins(x, edges) if len(x) else x
            f = pa.array([first] * part.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("weight"), pa.array([r.tobytes() for r in b], pa.binary()), f], ["y", "weight", "b", "f"])

    return rows.select("y", "weight", "x").mapInArrow(run, _STATE)


def boost(data: DataFrame, features: int, rounds: int = 10, classes: int = 3, rate: float = 0.1, leaves: int = 7, depth: int = 16, least: int = 8, strength: float = 5.0, most_bins: int = 63, edges: list[np.ndarray] | None = None) -> Boosted:
    """Boosted trees on histograms; missing values have a bin and learn their side.

    Each round grows a tree for each class, best gain first, up to ``leaves``
    leaves of ``least`` rows.  All classes' open nodes share a pass; a round
    takes about as many passes as its trees are deep.  Rows are written to the
    shared folder once as bins, a byte a feature, and again every
    ``WRITE_EVERY`` rounds with their scores.
    """
    rows = rows_of(data)
    if edges is None:
        edges = thresholds(bins(rows, most_bins), features)
    model = Boosted(start(rows, classes))

    width = max(len(e) for e in edges) + 2
    state = checkpointed(encoded(rows, features, edges, model.base))
    since: list[list[Tree]] = []
    for turn in range(rounds):
        growing = [_Growing(edges) for _ in model.base]
        while True:
            plans = [g.plan(leaves, depth, least) for g in growing]
            if not any(ask for _, ask in plans):
                break
            open_trees, slots, owner = [], [], []
            for k, (g, (_, ask)) in enumerate(zip(growing, plans, strict=True)):
                tree, place = g.tree(None, strength, rate)
                open_trees.append(tree)
                slots.append({place[i]: len(owner) + j for j, i in enumerate(ask)})
                owner += [(k, i) for i in ask]
            found: dict[int, dict] = {}
            for r in candidate_splits(histograms(state, features, since, open_trees, slots, width), width, strength, least).collect():  # one for each node and partition
                if r["slot"] not in found or _order(r) > _order(found[r["slot"]]):
                    found[r["slot"]] = r.asDict()
            for slot, (k, i) in enumerate(owner):
                growing[k].learn(i, found.get(slot, {"gain": None} | {f"all_{s}": 0.0 for s in ("n", "c", "g", "h")}))
        grown = [g.tree(chosen, strength, rate)[0] for g, (chosen, _) in zip(growing, plans, strict=True)]
        model.trees.append(grown)
        since = [*since, grown]
        if len(since) == WRITE_EVERY and turn + 1 < rounds:
            state = checkpointed(_rescored(state, features, since))
            since = []
    return model


def _rescored(state: DataFrame, features: int, trees: list[list[Tree]]) -> DataFrame:
    def run(batches):
        for part in _parts(batches, features):
            b = np.frombuffer(b"".join(part.column("b").to_pylist()), np.uint8).reshape(part.num_rows, features)
            raw = _added(matrix_of(part.column("f")).copy(), trees, _of_bins(b), True)
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * raw.shape[1], pa.int32()), pa.array(raw.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("weight"), part.column("b"), f], ["y", "weight", "b", "f"])

    return state.mapInArrow(run, _STATE)


def scored(data: DataFrame, proba: Callable[[np.ndarray], np.ndarray], classes: int = 3) -> DataFrame:
    """``subject, y, p0, ...`` by a function of matrices, such as a model's ``proba``; one pass."""
    kind = data.schema["subject"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in _parts([batch], 256):
                p = proba(matrix_of(part.column("x"))) if part.num_rows else np.zeros((0, classes))
                yield pa.RecordBatch.from_arrays([part.column("subject"), part.column("y"), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(classes))], ["subject", "y", *(f"p{k}" for k in range(classes))])

    rows = data.select("subject", F.col("y").cast("int").alias("y"), F.col("x").cast("array<double>").alias("x"))
    return rows.mapInArrow(run, f"subject {kind}, y int, " + ", ".join(f"p{k} double" for k in range(classes)))


# ---- extremely randomised trees -----------------------------------------


def draw_features(seed: int, tree: int, node: int, features: int) -> np.ndarray:
    """The order in which a node looks at features: the same wherever it is computed."""
    return np.random.default_rng([seed, tree, node]).permutation(features)


def draw_threshold(seed: int, tree: int, node: int, feature: int, low: float, high: float) -> float:
    """A threshold between a node's ends of a feature, the upper one left out."""
    t = low + np.random.default_rng([seed, tree, node, feature]).random() * (high - low)
    return float(t if t < high else low)


@dataclass
class Forest:
    """Trees whose ``value`` is a row of class shares for each node."""

    trees: list[Tree]

    def proba(self, x: np.ndarray) -> np.ndarray:
        return sum(t.value[t.leaves(_of(x), len(x))] for t in self.trees) / len(self.trees)


def extra_trees(data: DataFrame, features: int, trees: int = 20, classes: int = 3, least: int = 2, depth: int = 8, tried: int | None = None, seed: int = 7) -> Forest:
    """Extremely randomised trees: each node tries ``tried`` features at one random threshold each.

    Two passes a level, for all trees at once: ends of the tried features in
    each open node, then class weights on both sides.  The split of least Gini
    impurity wins, ties by the order of the draw.  A node whose tried features
    are all constant tries the next ones.  Missing values are an error: fill
    them first, as for every model that takes none.
    """
    tried = tried or max(1, int(np.sqrt(features)))
    rows = checkpointed(rows_of(data).select("y", "weight", "x"))
    grown: list[dict[int, dict]] = [{1: {"turn": 0}} for _ in range(trees)]  # children of i are 2 i and 2 i + 1

    def tree_of(nodes: dict[int, dict]) -> tuple[Tree, dict[int, int]]:
        order, place = [1], {1: 0}
        for i in order:
            if "feature" in nodes[i]:
                for j in (2 * i, 2 * i + 1):
                    place[j] = len(order)
                    order.append(j)
        own = [nodes[i] for i in order]
        links = [np.array([place[2 * i + s] if "feature" in nodes[i] else -1 for i in order], np.int64) for s in (0, 1)]
        feature = np.array([n.get("feature", -1) for n in own], np.int64)
        shares = np.array([n["w"] / n["w"].sum() if "w" in n and n["w"].sum() else np.full(classes, 1 / classes) for n in own])
        cover = np.array([n["w"].sum() if "w" in n else 0.0 for n in own])
        return Tree(feature, np.array([n.get("threshold", np.inf) for n in own], float), np.zeros(len(own), np.int64), np.ones(len(own), bool), *links, shares, cover), place

    while True:
        frozen = [tree_of(g) for g in grown]
        tries: dict[tuple[int, int], np.ndarray] = {}
        for t, g in enumerate(grown):
            for i, n in g.items():
                if "feature" in n or n.get("done"):
                    continue
                tries[t, i] = draw_features(seed, t, i, features)[n["turn"] * tried : (n["turn"] + 1) * tried]
        if not tries:
            return Forest([f[0] for f in frozen])
        slot_of = {key: s for s, key in enumerate(tries)}
        width = max(len(c) for c in tries.values())
        table = np.array([np.pad(c, (0, width - len(c)), mode="edge") for c in tries.values()])  # a last, shorter turn repeats a feature
        numbers = []
        for t, (tree, place) in enumerate(frozen):
            number = np.full(len(tree.feature), -1)
            for (u, i), s in slot_of.items():
                if u == t:
                    number[place[i]] = s
            numbers.append(number)
        spans = _spans(rows, [f[0] for f in frozen], numbers, table)
        limits = np.full(table.shape, np.nan)
        for (t, i), s in slot_of.items():
            for c in range(width):
                if s in spans and spans[s][c][0] < spans[s][c][1]:
                    limits[s, c] = draw_threshold(seed, t, i, int(table[s, c]), *spans[s][c])
        sides = _sides(rows, [f[0] for f in frozen], numbers, table, limits, classes)
        for (t, i), s in slot_of.items():
            n = grown[t][i]
            n.setdefault("w", sides["w"][s, 0].sum(0))
            best = None
            for c in range(width):
                (nl, nr), (wl, wr) = sides["n"][s, c], sides["w"][s, c]
                if np.isnan(limits[s, c]) or nl < least or nr < least:
                    continue
                impurity = sum(w.sum() - (w**2).sum() / w.sum() for w in (wl, wr))
                if best is None or round(impurity, 9) < round(best[0], 9):
                    best = (impurity, c, wl, wr, nl, nr)
            if best is None:
                n["turn"] += 1
                if not np.isnan(limits[s]).all() or n["turn"] * tried >= features:
                    n["done"] = True
                continue
            _, c, wl, wr, nl, nr = best
            n.update(feature=int(table[s, c]), threshold=float(limits[s, c]))
            for j, w, m in ((2 * i, wl, nl), (2 * i + 1, wr, nr)):
                grown[t][j] = {"turn": 0, "w": w, "done": m < 2 * least or (w > 0).sum() < 2 or j.bit_length() > depth}


def _slots(tree: Tree, number: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lie in a numbered node, and its number."""
    slot = number[tree.leaves(_of(x), len(x))]
    rows = np.flatnonzero(slot >= 0)
    return rows, slot[rows]


def _spans(rows: DataFrame, trees: list[Tree], numbers: list[np.ndarray], table: np.ndarray) -> dict[int, dict[int, tuple[float, float]]]:
    """Least and largest value of each tried feature in each numbered node."""
    shape = table.shape

    def run(batches):
        low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
        for part in _parts(batches, 256):
            x = matrix_of(part.column("x"))
            if np.isnan(x).any():
                raise ValueError("missing values: fill them before growing random trees")
            for tree, number in zip(trees, numbers, strict=True):
                at, slot = _slots(tree, number, x)
                v = x[at[:, None], table[slot]]
                np.minimum.at(low, slot, v)
                np.maximum.at(high, slot, v)
        s, c = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(low[s, c]), pa.array(high[s, c])], ["slot", "c", "low", "high"])

    ends = rows.select("x").mapInArrow(run, "slot int, c int, low double, high double").groupBy("slot", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, dict[int, tuple[float, float]]] = {}
    for r in ends.collect():
        out.setdefault(r["slot"], {})[r["c"]] = (r["low"], r["high"])
    return out


def _sides(rows: DataFrame, trees: list[Tree], numbers: list[np.ndarray], table: np.ndarray, limits: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """Rows and class weights left and right of each tried threshold."""
    slots, width = table.shape
    size = slots * width * 2 * classes

    def run(batches):
        n, w = np.zeros(size), np.zeros(size)
        for part in _parts(batches, 256):
            x, y, weight = matrix_of(part.column("x")), part.column("y").to_numpy(), part.column("weight").to_numpy()
            for tree, number in zip(trees, numbers, strict=True):
                at, slot = _slots(tree, number, x)
                with np.errstate(invalid="ignore"):
                    right = ~(x[at[:, None], table[slot]] <= limits[slot])
                cell = (((slot[:, None] * width + np.arange(width)) * 2 + right) * classes + y[at, None]).ravel()
                n += np.bincount(cell, minlength=size)
                w += np.bincount(cell, np.repeat(weight[at], width), minlength=size)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(n[held].astype(np.int64)), pa.array(w[held])], ["cell", "n", "w"])

    n, w = np.zeros(size), np.zeros(size)
    for r in rows.mapInArrow(run, "cell long, n long, w double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect():
        n[r["cell"]], w[r["cell"]] = r["n"], r["w"]
    return {"n": n.reshape(slots, width, 2, classes).sum(3), "w": w.reshape(slots, width, 2, classes)}


# ---- models as tables ----------------------------------------------------

_NODES = "turn int, klass int, node int, feature int, threshold double, cut int, missing_left boolean, left int, right int, value double, cover double"


def model_table(spark: SparkSession, model: Boosted) -> DataFrame:
    """A boosted model as rows, a node each; starting scores are nodes of turn -1."""
    rows = [(-1, k, 0, -1, None, 0, True, -1, -1, float(v), 0.0) for k, v in enumerate(model.base)]
    for turn, trees in enumerate(model.trees):
        for k, t in enumerate(trees):
            for i in range(len(t.feature)):
                inner = t.feature[i] >= 0
                rows.append((turn, k, i, int(t.feature[i]), float(t.threshold[i]) if inner else None, int(t.cut[i]), bool(t.missing_left[i]), int(t.left[i]), int(t.right[i]), float(t.value[i]), float(t.cover[i])))
    return spark.createDataFrame(rows, _NODES)


def model_of(table: DataFrame) -> Boosted:
    """The boosted model of a table of nodes; gaps in its rows are an error."""
    rows = sorted(table.collect(), key=lambda r: (r["turn"], r["klass"], r["node"]))
    base = [r["value"] for r in rows if r["turn"] == -1]
    trees: dict[tuple[int, int], list] = {}
    for r in rows:
        if r["turn"] >= 0:
            trees.setdefault((r["turn"], r["klass"]), []).append(r)
    turns = len(trees) // max(1, len(base))
    if not base or set(trees) != {(t, k) for t in range(turns) for k in range(len(base))} or any([r["node"] for r in own] != list(range(len(own))) for own in trees.values()):
        raise ValueError("the table lacks nodes of its model")

    def tree(own: list) -> Tree:
        col = lambda name, kind: np.array([r[name] for r in own], kind)
        limit = np.array([np.inf if r["threshold"] is None else r["threshold"] for r in own], float)
        return Tree(col("feature", np.int64), limit, col("cut", np.int64), col("missing_left", bool), col("left", np.int64), col("right", np.int64), col("value", float), col("cover", float))

    return Boosted(np.array(base), [[tree(trees[t, k]) for k in range(len(base))] for t in range(turns)])


# ---- exact Shapley values ------------------------------------------------


@dataclass
class Path:
    """One leaf's conditions, by feature: which nodes, which way, and the share of rows that go that way."""

    value: float
    features: np.ndarray
    steps: list[list[tuple[int, bool]]]
    share: np.ndarray


def paths_of(tree: Tree) -> list[Path]:
    """All leaves of a tree with their conditions merged by feature."""
    out = []
    stack: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
    while stack:
        node, way = stack.pop()
        if tree.feature[node] >= 0:
            stack += [(tree.left[node], [*way, (node, True)]), (tree.right[node], [*way, (node, False)])]
            continue
        steps: dict[int, list[tuple[int, bool]]] = {}
        share: dict[int, float] = {}
        for at, left in way:
            f = int(tree.feature[at])
            child = tree.left[at] if left else tree.right[at]
            steps.setdefault(f, []).append((at, left))
            share[f] = share.get(f, 1.0) * (tree.cover[child] / tree.cover[at] if tree.cover[at] else 0.5)
        out.append(Path(float(tree.value[node]), np.array(list(steps), np.int64), list(steps.values()), np.array(list(share.values()))))
    return out


def pattern_values(path: Path, met: np.ndarray) -> np.ndarray:
    """Shapley values of a path's features for patterns of conditions met (rows of 0 and 1).

    The path's game pays its value times, for each feature, 1 or 0 if it is in
    the coalition (condition met or not) and its share of rows if it isn't.
    """
    m = len(path.features)
    fact = np.cumprod([1.0, *range(1, m + 1)])
    out = np.zeros(met.shape)
    for i in range(m):
        # coefficients by size of the coalition, over all other features
        poly = np.zeros((len(met), m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                more = poly * path.share[j]
                more[:, 1:] += poly[:, :-1] * met[:, j : j + 1]
                poly = more
        sizes = np.arange(m)
        out[:, i] = path.value * (met[:, i] - path.share[i]) * (poly @ (fact[sizes] * fact[m - 1 - sizes] / fact[m]))
    return out


def expected(model: Boosted) -> np.ndarray:
    """The model's mean raw scores over its training rows: what it says where every feature is left open."""
    out = model.base.copy()
    for turn in model.trees:
        for k, tree in enumerate(turn):
            leaf = tree.feature < 0
            out[k] += np.average(tree.value[leaf], weights=tree.cover[leaf]) if tree.cover[leaf].any() else tree.value[leaf].mean()
    return out


def contributions_of(model: Boosted, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of all rows: rows by classes by features."""
    out = np.zeros((len(x), len(model.base), x.shape[1]))
    for turn in model.trees:
        for k, tree in enumerate(turn):
            inner = np.flatnonzero(tree.feature >= 0)
            if not len(inner):
                continue
            v = x[:, tree.feature[inner]]
            with np.errstate(invalid="ignore"):
                left = np.where(np.isnan(v), tree.missing_left[inner], v <= tree.threshold[inner])
            column = {node: left[:, i] for i, node in enumerate(inner)}
            for path in paths_of(tree):
                met = np.stack([np.logical_and.reduce([column[n] == way for n, way in steps]) for steps in path.steps], 1)
                # rows that meet the same conditions share their values
                patterns, which = np.unique(met, axis=0, return_inverse=True)
                out[:, k, path.features] += pattern_values(path, patterns.astype(float))[which.ravel()]
    return out


def contributions(data: DataFrame, model: Boosted, tolerance: float = 1e-5) -> DataFrame:
    """Exact Shapley values of a boosted model's raw scores: ``subject, klass, base, raw, phi``.

    ``phi`` has a number for each feature; with ``base`` they add up to
    ``raw``.  A row where they don't, by ``tolerance``, ends the job.  The
    model's paths go to the rows; rows aren't shuffled.
    """
    kind = data.schema["subject"].dataType.simpleString()
    start_at = expected(model)

    def run(batches):
        for part in _parts(batches, 64 * len(model.base)):
            x = matrix_of(part.column("x"))
            if not len(x):
                continue
            phi, raw = contributions_of(model, x), model.raw(x)
            gap = np.abs(phi.sum(2) + start_at - raw).max()
            if not gap <= tolerance:
                raise ValueError(f"contributions miss the score by {gap:.3g}")
            n, k, d = phi.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n * k + 1) * d, pa.int32()), pa.array(phi.ravel()))
            subject = part.column("subject").take(pa.array(np.repeat(np.arange(n), k)))
            yield pa.RecordBatch.from_arrays([subject, pa.array(np.tile(np.arange(k), n), pa.int32()), pa.array(np.tile(start_at, n)), pa.array(raw.ravel()), lists], ["subject", "klass", "base", "raw", "phi"])

    return data.select("subject", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, f"subject {kind}, klass int, base double, raw double, phi array<double>")
