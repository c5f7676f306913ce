import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import champion as c
from diurna.operators import trees
from test_trees import D, table
from test_wearables import activity, sleep, write

MEMBERS = [c.Member("a", "b", 0.8, 0.1), c.Member("a", "c", cn_mci_temperature=2.0, cn_mci_bias=-0.2)]
WEIGHTS = [[1, 2, 1], [3, 1, 1]]


@pytest.fixture(scope="module")
def fitted(spark):
    data, x, y, _ = table(spark, 120)
    parameters = {"a": {"rounds": 1, "least": 5}, "b": {"rounds": 2, "least": 5, "strength": 1.0}, "c": {"rounds": 1, "least": 5, "strength": 1.0}}
    return data, x, y, c.fit(data, [f"f{i}" for i in range(D)], MEMBERS, WEIGHTS, [0.0, 0.2, 0.1], parameters)


def test_votes_by_hand(fitted):
    data, x, _, champ = fitted
    total = np.zeros((len(x), 3))
    for m, w in zip(MEMBERS, np.array(WEIGHTS) / np.sum(WEIGHTS, 0), strict=True):
        logit = lambda p: np.log(p / (1 - p))
        d = 1 / (1 + np.exp(-(logit(champ.models[m.dem].proba(x)[:, 1]) / m.dem_temperature + m.dem_bias)))
        q = 1 / (1 + np.exp(-(logit(champ.models[m.cn_mci].proba(x)[:, 1]) / m.cn_mci_temperature + m.cn_mci_bias)))
        total += w * np.stack([(1 - d) * (1 - q), (1 - d) * q, d], 1)
    total /= total.sum(1, keepdims=True)
    got = {r.subject: r for r in champ.predict(data).collect()}
    assert np.allclose([[got[i].p0, got[i].p1, got[i].p2] for i in range(len(x))], total)
    assert [got[i].predicted for i in range(len(x))] == (np.log(total) + [0.0, 0.2, 0.1]).argmax(1).tolist()


def test_saved_read_and_reproduced(spark, fitted, tmp_path):
    data, x, _, champ = fitted
    c.save(spark, champ, str(tmp_path / "m"))
    back = c.load(spark, str(tmp_path / "m"))
    assert back.features == champ.features and back.members == champ.members
    saved = champ.predict(data)
    r = c.reproduction(saved, back.predict(data)).first()
    assert (r["n"], r["gap"], r["same"]) == (len(x), 0.0, len(x))
    with pytest.raises(Exception, match="not reproduced"):
        c.reproduction(saved, back.predict(data.filter("subject > 0"))).collect()
    with pytest.raises(Exception, match="not reproduced"):
        c.reproduction(saved, back.predict(data).withColumn("p1", F.col("p1") + F.when(F.col("subject") == 5, 1e-3).otherwise(0))).collect()
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        c.save(spark, champ, str(tmp_path / "m"))
    nodes = spark.read.parquet(str(tmp_path / "m" / "nodes"))
    nodes.withColumn("value", F.col("value") + F.when(F.col("turn") == 0, 1e-9).otherwise(0)).write.parquet(str(tmp_path / "x" / "nodes"))
    spark.read.parquet(str(tmp_path / "m" / "settings")).write.parquet(str(tmp_path / "x" / "settings"))
    with pytest.raises(ValueError, match="isn't the one"):
        c.load(spark, str(tmp_path / "x"))


def test_branches_are_explained_through_their_own_subjects(spark, fitted):
    data, x, y, champ = fitted
    few = data.filter("subject < 20")
    parts = []
    for number in (0, 1):
        for role in c.ROLES:
            ground = c.background_rows(data, role, 7, 10)
            assert len(ground) == 10
            part = c.branch_contributions(few, champ, number, role, ground, 7)
            parts.append((number, role, part))
            got = {}
            for r in part.collect():
                got.setdefault(r.subject, []).append(r.contribution)
            own = [i for i in range(20) if role == "dem" or y[i] != 2]
            assert sorted(got) == own
            member = champ.members[number]
            gain = champ.branch(member, role, x[own]) - champ.branch(member, role, ground).mean()
            assert np.allclose([sum(got[i]) for i in own], gain, atol=1e-9)
    whole, both = c.branch_importance(parts, champ)
    want: dict = {}
    for r in whole.collect():
        total = sum(q.mean_abs for q in whole.collect() if (q.member, q.role) == (r.member, r.role))
        all_weights = sum(w[c.ROLES[r.role]] for w in WEIGHTS)
        want[r.role, r.feature] = want.get((r.role, r.feature), 0) + (r.mean_abs / total if total else 0) * r.weight / all_weights
    got = {(r.role, r.feature): (r.importance, r["rank"]) for r in both.collect()}
    assert all(abs(got[k][0] - v) < 1e-12 for k, v in want.items()) and len(got) == 2 * D
    assert sorted(r for (role, _), (_, r) in got.items() if role == "dem") == list(range(1, D + 1))


def test_local_examples(spark):
    rows = [(5, 0, 0), (3, 0, 0), (1, 0, 1), (7, 1, 1), (2, 2, 0)]
    got = c.local_examples(spark.createDataFrame(rows, "subject int, y int, predicted int")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 3), (1, 7)]


def test_from_recordings_to_classes(spark, tmp_path):
    """Two CSV files, no labels; a subject of few days is left out."""
    from diurna.sources import wearables as w

    rows = [activity(d, activity_steps=900 + d) for d in range(1, 9)] + [activity(1, EMAIL="b@x.org")]
    nights = [sleep(d, sleep_total=60 + d) for d in range(1, 9)]
    a = write(tmp_path / "a.csv", w.RECORDINGS["activity"], rows)
    s = write(tmp_path / "s.csv", w.RECORDINGS["sleep"], nights)
    stump = lambda cut, low, high: trees.Boosted(np.array([0.0]), [[trees.Tree(np.array([0, -1, -1]), np.array([cut, np.inf, np.inf]), np.zeros(3, int), np.ones(3, bool), np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([0.0, low, high]), np.array([2.0, 1.0, 1.0]))]])
    champ = c.Champion({"a": stump(500.0, -3.0, 3.0), "b": stump(500.0, 1.0, -1.0)}, [c.Member("a", "b")], [[1, 1, 1]], [0.0, 0.0, 0.0], ["activity__steps__median"])
    got = c.predict_recordings(spark, champ, a, s).collect()
    assert len(got) == 1 and got[0].observed_days == 9 and got[0].predicted == "DEM" and got[0].p2 > 0.9
    champ.features = ["no such feature"]
    with pytest.raises(ValueError, match="missing features"):
        c.predict_recordings(spark, champ, a, s)
