"""Signal operators: SQL checks on small tables, and hand-computed cases."""

import datetime
import hashlib
import math
import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from diurna.functions import scalars
from diurna.operators import learners, policy, ranking, sequences, summaries
from diurna.plans import learner_queries, model_queries, record_queries, signal_queries

DATA = "/root/testdata/sf0.001"
ORACLES = {n: (m, n) for m in (signal_queries, model_queries, record_queries) for n in m.ORACLE_SQL}


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    return f"{v:.8g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "__index__") else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(spark, duck, name):
    module, _ = ORACLES[name]
    mine = module.QUERIES[name](spark, DATA)
    theirs = duck.sql(module.ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    a = sorted(tuple(plain(r[c]) for c in columns) for r in mine.collect())
    b = sorted(tuple(plain(r[i]) for i in order) for r in theirs.fetchall())
    assert a == b


def test_gaps_are_not_bridged(spark):
    day = lambda d: datetime.date(2026, 1, d)
    rows = [("s", day(d), "m", float(v)) for d, v in ((1, 10), (2, 11), (5, 100), (6, 101))]
    r = summaries.calendar_dynamics(spark.createDataFrame(rows, "subject string, date date, metric string, value double")).first()
    assert r["moving_range"] == 1 and r["rmssd"] == 1


def test_rate_drop_keeps_positions(spark):
    df = spark.createDataFrame([("s", "0/100/90/80/70", 7200.0, 10800.0, 22.0)], "subject string, p string, nrem double, total double, start double")
    df = df.withColumn("seq", sequences.parse_sequence(F.col("p"), positive_only=True))
    r = sequences.rate_drop(df, ["subject"], "seq", "nrem", "total", "start").first()
    assert r["baseline"] == 95 and math.isclose(r["drop_ratio"], 25 / 95) and math.isclose(r["drop_firstvalid_ratio"], 20 / 90)


def test_parse_sequence(spark):
    df = spark.createDataFrame([("1//3/ /",), ("...",), (None,), ("",), ("nan",), ("///",), ("1d/-2/inf/x",)], "p string")
    got = [r[0] for r in df.select(sequences.parse_sequence(F.col("p"))).collect()]
    assert got == [[1.0, None, 3.0], [], [], [], [], [], [None, -2.0, None, None]]


def test_local_timestamp(spark):
    df = spark.createDataFrame([("2026-01-01T00:30:00+09:00",), ("2026-01-01 00:30:00",), ("2025-12-31T15:30:00Z",), ("junk",), (None,)], "t string")
    got = [r[0] for r in df.select(scalars.local_timestamp(F.col("t")).cast("string")).collect()]
    assert got == ["2026-01-01 00:30:00"] * 3 + [None, None]


def test_argmax_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(scalars.argmax([F.col(c) for c in "abc"])).collect()] == [0, 1, 0, 2]


def test_hierarchy_and_constant_scores(spark):
    df = spark.createDataFrame([(0.2, 0.4)], "d double, q double")
    r = df.select(*[c.alias(f"p{k}") for k, c in enumerate(policy.nested_scores(policy.tempered(F.col("d")), policy.tempered(F.col("q"))))]).first()
    assert [round(x, 9) for x in r] == [0.48, 0.32, 0.2]


def test_breakpoints_never_lower_recall(spark):
    import numpy as np

    p = np.random.default_rng(27).dirichlet([1, 1, 1], 18)
    df = spark.createDataFrame([(i, i % 3, *map(float, x)) for i, x in enumerate(p)], "id int, y int, p0 double, p1 double, p2 double")
    start = policy.evaluate_offsets(df, [(0.0, 0.0)]).first()
    best = policy.breakpoint_policy(df, (0.0, 0.0)).first()
    assert best["macro_recall"] >= start["macro_recall"]
    again = policy.evaluate_offsets(df, [(best["a"], best["b"])]).first()
    assert math.isclose(again["macro_recall"], best["macro_recall"])
    # no pair of a fine grid does better
    grid = [i / 8 for i in range(-40, 41)]
    key = lambda r: (round(r["macro_recall"], 9), round(r["min_recall"], 9), round(r["macro_f1"], 9))
    assert key(best) >= max(map(key, policy.evaluate_offsets(df, policy.grid(grid)).collect()))


def test_breakpoints_equal_all_lines(spark):
    """Levels and blocks leave out nothing: small pieces, ties and repeated cases."""
    import numpy as np

    rng = np.random.default_rng(5)
    p = np.round(rng.dirichlet([1, 1, 1], 22), 2) + 0.01
    y = [int(v) for v in rng.integers(0, 3, 22)] + [0, 1]
    p = np.vstack([p, p[:2]])
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in zip(y, p, strict=True)], "y int, p0 double, p1 double, p2 double")
    logs = np.log(np.clip(p, 1e-12, 1))
    u, v = logs[:, 0] - logs[:, 2], logs[:, 1] - logs[:, 2]
    truth = np.array(y)

    def middles(values):
        d = sorted(set(values))
        return [d[0] - 1, *[(x + z) / 2 for x, z in zip(d, d[1:], strict=False)], d[-1] + 1]

    def key(a, b):
        first = u >= v + a
        said = np.where(np.maximum(u, v + a) < b, 2, np.where(first, 0, 1))
        recall = [np.mean(said[truth == k] == k) for k in range(3)]
        f1 = [2 * np.sum((said == k) & (truth == k)) / (np.sum(said == k) + np.sum(truth == k)) for k in range(3)]
        norm = np.sqrt(np.sum((np.array([0, a, b]) - (a + b) / 3) ** 2))
        return tuple(round(float(x), 12) for x in (np.mean(recall), min(recall), np.mean(f1), -norm))

    best = max(key(a, b) for a in middles([x - z for x in u for z in v]) for b in middles(np.maximum(u, v + a)))
    for pieces in (16, 512):
        got = policy.breakpoint_policy(df, (0.0, 0.0), pieces).first()
        assert all(math.isclose(x, z, abs_tol=1e-9) for x, z in zip(best, (got["macro_recall"], got["min_recall"], got["macro_f1"], -got["norm"]), strict=True))
    lacking = df.filter("y <> 1")
    assert policy.breakpoint_policy(lacking, (0.25, -0.25)).first()["a"] == 0.25
    assert policy.breakpoint_policy(df.limit(0), (0.25, -0.25)).count() <= 1


def test_breakpoints_write_no_lines(spark, monkeypatch):
    """Lines are the square of the cases: nothing of that size is written, and all pairs are still compared."""
    import numpy as np

    rng = np.random.default_rng(9)
    p = np.exp(rng.normal(0, 0.1, (240, 3)))
    p = np.round(p / p.sum(1, keepdims=True), 4)
    truth = rng.integers(0, 3, 240)
    df = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(truth, p, strict=True)], "y int, p0 double, p1 double, p2 double").cache()
    sizes = []
    write = policy.checkpointed

    def counted(rows):
        out = write(rows)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(policy, "checkpointed", counted)
    got = policy.breakpoint_policy(df, (0.0, 0.0)).first()
    lines = 240 * 240
    assert max(sizes) < lines / 3
    # the first cuts, by sums of many tasks, lose nothing either
    monkeypatch.setattr(policy, "CELL_CASES", 60)
    assert policy.breakpoint_policy(df, (0.0, 0.0)).first() == got
    logs = np.log(p)
    u, v = logs[:, 0] - logs[:, 2], logs[:, 1] - logs[:, 2]
    d = np.unique(u[:, None] - v)
    share = 1 / (3 * np.bincount(truth)[truth])
    best = 0.0
    for a in np.r_[d[0] - 1, (d[1:] + d[:-1]) / 2, d[-1] + 1]:
        first, top = u >= v + a, np.maximum(u, v + a)
        order = np.argsort(top)
        loses = np.where(truth == 2, 0, np.where(first, truth == 0, truth == 1)) * share
        change = np.where(truth == 2, share, 0) - loses
        best = max(best, loses.sum() + max(0, np.cumsum(change[order]).max()))
    assert math.isclose(got["macro_recall"], best, abs_tol=1e-12)
    df.unpersist()


def test_midpoints(spark):
    values = [3.0, 1.0, 1.0, None, 10.0, 4.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for buckets in (2, 64):
        assert sorted(r["v"] for r in ranking.midpoints(df, "v", buckets).collect()) == [0.0, 2.0, 3.5, 7.0, 11.0]
    assert ranking.midpoints(df.limit(0), "v").count() == 0


def test_running_totals(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 501).cast("double").alias("s"), F.lit(1).alias("n"))
    for r in ranking.running_totals(df, ["g"], "s", ["n"], descending=True, buckets=8).collect():
        assert r["cum_n"] == df.filter((F.col("g") == r["g"]) & (F.col("s") >= r["s"])).count() if r["s"] % 100 == 0 else True


def test_neighbours_and_oversampling(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(1).normal(size=(40, 3))
    y = [0] * 24 + [1] * 10 + [2] * 6
    df = spark.createDataFrame([(i, y[i], list(map(float, v))) for i, v in enumerate(x)], "subject long, y int, f array<double>").select("subject", "y", array_to_vector("f").alias("features"))
    for block in (1024, 4):
        got = {(r["subject"], r["rank"]): r["neighbour"] for r in learners.neighbours(df, 3, block).collect()}
        for i in range(40):
            near = sorted((np.linalg.norm(x[i] - x[j]), j) for j in range(40) if y[j] == y[i] and j != i)[:3]
            assert [got[i, k] for k in range(3)] == [j for _, j in near]
    new = learners.oversample(df, 5).collect()
    assert sorted(r["y"] for r in new) == [1] * 14 + [2] * 18
    assert all(y[r["parent"]] == r["y"] == y[r["neighbour"]] for r in new)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_learner_queries_use_all_features_and_subjects(spark, monkeypatch):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    run = learner_queries.QUERIES
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert run["kernel_scores"](spark, DATA).select("subject").distinct().count() == n
    assert len(run["oversampled"](spark, DATA).first()["features"]) == 64
    every = {(r["a"], r["b"]): r["r"] for r in run["embedding_correlations"](spark, DATA).collect()}
    assert len(every) == 64 * 63 // 2
    assert all(abs(every[r["a"], r["b"]] - r["r"]) < 1e-6 for r in model_queries.feature_correlations(spark, DATA).collect())
    asked = []
    monkeypatch.setattr(learners, "permutation_importance", lambda score, long, features, repeats, seed: asked.append((list(features), repeats)) or long)
    run["permuted_importance"](spark, DATA)
    assert asked == [(list(range(64)), 50)]


def test_permuted_importance_by_hand(spark):
    """Feature 1 is the class's score, feature 0 is noise."""
    rows = [(i, i % 3, f, float((7 * i) % 5) if f == 0 else float(i % 3)) for i in range(60) for f in (0, 1)]
    long = spark.createDataFrame(rows, "subject long, y int, feature int, value double")

    def scored(df):
        x = F.col("v")[1]
        at = df.withColumn("v", vector_to_array("features"))
        return at.select("subject", "y", *[(-F.abs(x - k)).alias(f"p{k}") for k in range(3)])

    got = {(r["feature"], r["repeat"]): r["drop"] for r in learners.permutation_importance(scored, long, [0, 1], 3, 5).collect()}
    assert len(got) == 6
    for r in range(3):
        assert abs(got[0, r]) < 1e-12
        order = lambda seed: sorted(range(60), key=lambda i: hashlib.md5(f"{seed}:{r}:{i}".encode()).hexdigest())
        x = {s: d % 3 for s, d in zip(order(5), order(6), strict=True)}
        auc = []
        for k in range(3):
            p, q = [-abs(x[i] - k) for i in x if i % 3 == k], [-abs(x[i] - k) for i in x if i % 3 != k]
            auc.append(sum((a > c) + (a == c) / 2 for a in p for c in q) / len(p) / len(q))
        assert abs(got[1, r] - (1 - sum(auc) / 3)) < 1e-9


def test_daily_sums_whatever_the_order_of_rows(spark):
    from datetime import datetime, timedelta

    from diurna.operators import days

    values = [1.62, 2.32, 14.36, 4.83, None]  # 23.13 or 23.130000000000003, by the order of addition
    rows = [(7, datetime(2024, 1, 10) + timedelta(hours=i), v) for i, v in enumerate(values)]
    want = ((1.62 + 2.32) + 14.36) + 4.83
    for order in (rows, rows[::-1], [rows[i] for i in (3, 4, 1, 2, 0)]):
        for parts in (1, 3):
            df = spark.createDataFrame(order, "u int, ts timestamp, v double").repartition(parts)
            r = days.subject_days(df, "u", "ts", "v").first()
            assert (r["n_events"], r["sum_value"], r["mean_value"], r["max_value"]) == (5.0, want, want / 4, 14.36)
    none = spark.createDataFrame([rows[4]], "u int, ts timestamp, v double")
    assert days.subject_days(none, "u", "ts", "v").first()["sum_value"] is None


def test_events_of_one_time_are_summed_by_their_numbers(spark, tmp_path):
    """As SQL on one thread adds them up where a table holds copies of a user's events; before, by value."""
    from diurna.plans import bindings

    values = [14.36, 1.62, 4.83, 2.32]
    rows = [(i, datetime.datetime(2024, 1, 10), 7, "view", v) for i, v in enumerate(values)]
    want = ((14.36 + 1.62) + 4.83) + 2.32
    assert want != ((1.62 + 2.32) + 4.83) + 14.36
    spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    for r in (bindings.daily(spark, str(tmp_path)).first(), bindings.two_modalities(spark, str(tmp_path))[0].first()):
        assert (r["sum_value"], r["mean_value"]) == (want, want / 4)
