import hashlib

import numpy as np
from test_wearables import activity, sleep, write

from diurna.sources import temporal
from diurna.sources import wearables as w


def days(spark, tmp_path, kind, rows):
    r = w.RECORDINGS[kind]
    return w.subject_days(w.read_recording(spark, write(tmp_path / f"{kind}.csv", r, rows), r), r)[0]


def test_night_metrics(spark, tmp_path):
    hr = "/".join(str(60 + (i * 7) % 13) for i in range(20))
    s = days(spark, tmp_path, "sleep", [sleep(1, **{"CONVERT(sleep_hr_5min USING utf8)": hr}), sleep(1, sleep_duration=3)])
    out = temporal.night_metrics(s)
    assert len(out.columns) - 2 == 20
    one = out.first()
    x = np.array([60 + (i * 7) % 13 for i in range(20)], float)
    assert one["sleep__paper_hr_baseline_first15min"] == x[:3].mean() and one["sleep__paper_episode_count"] == 2.0
    assert abs(one["sleep__paper_hr_drop_ratio"] - (x[:3].mean() - x.min()) / x[:3].mean()) < 1e-9
    assert abs(one["sleep__paper_hr_drop05_per_nrem_hour"] - (x[:3].mean() - np.quantile(x, 0.05)) / (120 / 3600)) < 1e-6
    assert abs(one["sleep__paper_hr_slope_per_hour"] - np.polyfit(np.arange(20) / 12, x, 1)[0]) < 1e-9
    assert one["sleep__paper_bedtime_noon_unwrapped"] == 23.0 and one["sleep__paper_interval_hours"] == 8.0


def test_all_rows(spark, tmp_path):
    """Counts of features, and some against plain figures."""
    steps = {d: 100.0 * ((d * 5) % 7) for d in (1, 2, 3, 4, 5, 7, 8, 9, 10)}
    rows = [activity(d, activity_steps=v) for d, v in steps.items()] + [activity(d, EMAIL="b@x.org") for d in range(1, 5)] + [activity(d, EMAIL="c@x.org") for d in range(1, 9)]
    a = days(spark, tmp_path, "activity", rows)
    s = days(spark, tmp_path, "sleep", [sleep(d, sleep_total=60 + d) for d in range(1, 9)])
    table, meta = temporal.all_rows(a, s, str(tmp_path / "tables"))
    names = [n for n, _, _ in meta]
    assert len(names) == len(set(names)) == 5144
    assert sum(n.startswith("v3__") for n in names) == 3799 and sum(n.startswith("context__") for n in names) == 12
    table.write.parquet(str(tmp_path / "features"))
    table = spark.read.parquet(str(tmp_path / "features"))
    got = {(r["subject"], r["feature"]): r["value"] for r in table.collect()}
    assert table.count() == len(got) and {f for _, f in got} <= set(names)
    one, other = (hashlib.sha256(k).hexdigest() for k in (b"a@x.org", b"c@x.org"))
    assert {k for k, _ in got} == {one, other}
    x = np.array(list(steps.values()))
    near = [b - a for (i, a), (j, b) in zip(list(steps.items()), list(steps.items())[1:], strict=False) if j == i + 1]
    weekend = np.array([d in (3, 4, 10) for d in steps])  # of January 2026
    want = {
        "activity__steps__median": np.median(x), "activity__steps__extra_mean": x.mean(), "activity__steps__extra_std": x.std(), "activity__steps__extra_weekend_delta": x[weekend].mean() - x[~weekend].mean(),
        "v3__activity__steps__std": x.std(ddof=1), "v3__activity__steps__range": np.ptp(x), "v3__activity__steps__rmssd": np.sqrt(np.mean(np.square(near))),
        "v3__activity__steps__trend": np.polyfit(np.array(list(steps)) - 1, x, 1)[0], "context__activity__weekend_fraction": weekend.mean(), "v3__sleep__total__mean": 64.5,
        "v3__sleep__paper_episode_count__mean": 1.0, "activity__hour_05__std": 0.0,
    }
    for name, value in want.items():
        assert np.isclose(got[one, name], value, rtol=1e-5), name
    assert got[other, "sleep__total__missing_fraction"] == 1.0 and got[other, "sleep__quality_n_days"] == 0.0
    assert (other, "v3__sleep__total__mean") not in got
    kinds = {n: f for n, _, f in meta}
    assert kinds["v3__sleep__paper_episode_count__mean"] == "quality" and kinds["v3__sleep__score__cv"] == "vendor" and "v3__activity__non_wear__mean" not in kinds
    wide = temporal.widen(table, ["v3__activity__steps__std", "activity__steps__median"])
    assert wide.columns == ["subject", "v3__activity__steps__std", "activity__steps__median"] and wide.count() == 2
