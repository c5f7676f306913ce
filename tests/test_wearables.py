import pytest

from diurna.sources import tables
from diurna.sources import wearables as w


def write(path, r, rows):
    names = w.columns(r)
    lines = [",".join(names)] + [",".join(str(row.get(n, "")) for n in names) for row in rows]
    path.write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def activity(day, **more):
    met = "/".join(str(1 + (i // 60) % 3) for i in range(1440))
    state = "/".join(str(i % 6) for i in range(288))
    return {
        "EMAIL": " A@x.org ", **{f"activity_{n}": 5 for n in w.ACTIVITY_NUMBERS}, "activity_non_wear": 40, "activity_day_start": f"2026-01-{day:02d}T04:00:00+09:00",
        "activity_day_end": f"2026-01-{day + 1:02d}T03:59:59+09:00", "CONVERT(activity_class_5min USING utf8)": state + "//", "CONVERT(activity_met_1min USING utf8)": met,
    } | more


def sleep(day, **more):
    return {
        "EMAIL": "a@X.org", **{f"sleep_{n}": 60 for n in w.SLEEP_NUMBERS}, "sleep_bedtime_start": f"2026-01-{day:02d} 23:00:00", "sleep_bedtime_end": f"2026-01-{day + 1:02d} 07:00:00",
        "CONVERT(sleep_hr_5min USING utf8)": "0/60/70/80/0/60", "CONVERT(sleep_hypnogram_5min USING utf8)": "1/2//3/9/4/", "CONVERT(sleep_rmssd_5min USING utf8)": "...",
    } | more


def test_ingest(spark, tmp_path):
    r = w.RECORDINGS["activity"]
    path = write(tmp_path / "a.csv", r, [activity(1), activity(2), activity(2, activity_day_start="2026-01-02T03:00:00+09:00", activity_steps=-3), activity(3, activity_day_start="junk")])
    days, audit = w.subject_days(w.read_recording(spark, path, r), r)
    a = audit.first()
    assert (a["input_rows"], a["bad_dates"], a["duplicate_subject_dates"], a["kept_rows"], a["subjects"]) == (4, 1, 1, 2, 1)
    m = w.daily_metrics(days, r)
    assert len(m.columns) - 2 == 61
    rows = {str(x["date"]): x for x in m.collect()}
    assert rows["2026-01-02"]["activity__steps"] is None  # negative, of the earlier start
    one = rows["2026-01-01"]
    assert one["activity__met_length"] == 1440 and one["activity__state_length"] == 288
    assert one["activity__steps_per_wear_hour"] == 5 / (1400 / 60)
    assert one["activity__met_cosinor_amplitude"] is not None and one["activity__met_low5_met"] < one["activity__met_high10_met"]


def test_sleep(spark, tmp_path):
    r = w.RECORDINGS["sleep"]
    path = write(tmp_path / "s.csv", r, [sleep(1), sleep(1, sleep_duration=90, sleep_hr_average=0), sleep(2)])
    days, audit = w.subject_days(w.read_recording(spark, path, r), r)
    m = w.daily_metrics(days, r)
    assert len(m.columns) - 2 == 62 and audit.first()["duplicate_subject_dates"] == 1
    first = m.orderBy("date").first()
    assert str(first["date"]) == "2026-01-02" and first["sleep__duration"] == 90 and first["sleep__hr_average"] is None
    assert first["sleep__hr_length"] == 6 and first["sleep__hr_valid_fraction"] == 4 / 6 and first["sleep__hrv_length"] == 0
    assert first["sleep__state_length"] == 6 and first["sleep__state_code_4_longest_minutes"] == 5


def test_inference_needs_no_labels(spark, tmp_path):
    a = write(tmp_path / "a.csv", w.RECORDINGS["activity"], [activity(1), activity(2)])
    s = write(tmp_path / "s.csv", w.RECORDINGS["sleep"], [sleep(1), sleep(4), sleep(5, EMAIL="b@x.org")])
    metrics, days = w.inference_days(spark, a, s)
    assert metrics.count() == 4 and len(metrics.columns) == 2 + 61 + 62
    assert sorted(r["observed_days"] for r in days.collect()) == [1, 3]


def test_subject_features(spark, tmp_path):
    r = w.RECORDINGS
    rows = [activity(d, activity_steps=100 * d) for d in (1, 2, 3, 4, 5, 7, 8, 9, 10)] + [activity(d, EMAIL="b@x.org") for d in range(1, 5)] + [activity(d, EMAIL="c@x.org") for d in range(1, 9)]
    nights = [sleep(d, sleep_total=60 + d) for d in (1, 2, 3, 4, 5, 7, 8, 9)]
    a, _ = w.subject_days(w.read_recording(spark, write(tmp_path / "a.csv", r["activity"], rows), r["activity"]), r["activity"])
    s, _ = w.subject_days(w.read_recording(spark, write(tmp_path / "s.csv", r["sleep"], nights), r["sleep"]), r["sleep"])
    wide, meta = w.subject_features(a, s)
    assert len(wide.columns) == 1 + 670 and len({m[0] for m in meta}) == 670
    assert {t for _, t in wide.dtypes[1:]} == {"float"}
    import hashlib

    got = {x["subject"]: x for x in wide.collect()}
    one, other = (got.pop(hashlib.sha256(k).hexdigest()) for k in (b"a@x.org", b"c@x.org"))
    assert not got  # too few days
    assert (one["activity__steps__median"], one["activity__quality_n_days"], one["activity__quality_span_days"]) == (500.0, 9.0, 10.0)
    assert one["activity__steps__day_rmssd"] == 100.0 and abs(one["activity__steps__trend_per_day"] - 100.0) < 1e-3
    assert one["coupling__same_wake_day_n_pairs"] == 7.0 and abs(one["coupling__same_wake_day__steps__total_corr"] - 1) < 1e-6
    assert abs(one["sleep__bedtime_regularity"] - 1) < 1e-6 and one["activity__steps__missing_fraction"] == 0.0
    assert other["sleep__total__missing_fraction"] == 1.0 and other["sleep__quality_n_days"] == 0.0 and other["sleep__total__median"] is None


def test_guards(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("EMAIL,x\na,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        w.read_recording(spark, str(tmp_path / "bad.csv"), w.RECORDINGS["sleep"])
    with pytest.raises(ValueError, match="forbidden"):
        w.check_path("/x/MMSE.csv")
    (tmp_path / "l1.csv").write_text("SAMPLE_EMAIL,DIAG_NM\nA@x.org,cn\nb@x.org, Dem\n")
    (tmp_path / "l2.csv").write_text("SAMPLE_EMAIL,DIAG_NM\na@X.org,CN\n")
    assert sorted(r["label"] for r in w.read_labels(spark, [str(tmp_path / "l1.csv"), str(tmp_path / "l2.csv")]).collect()) == ["CN", "DEM"]
    (tmp_path / "l3.csv").write_text("SAMPLE_EMAIL,DIAG_NM\na@x.org,MCI\n")
    with pytest.raises(Exception, match="conflicting"):
        w.read_labels(spark, [str(tmp_path / "l1.csv"), str(tmp_path / "l3.csv")]).collect()
    assert w.fingerprint(spark, [str(tmp_path / "l1.csv")], {"a": 1}) != w.fingerprint(spark, [str(tmp_path / "l1.csv")], {"a": 2})


def test_files_are_read_by_name(spark, tmp_path):
    r = w.RECORDINGS["sleep"]
    names = w.columns(r)
    turned = [*names[1:], "extra", names[0]]
    night = sleep(1, sleep_duration=100, sleep_score=7)
    other = sleep(3, sleep_duration=90, sleep_score=8)
    (tmp_path / "n").mkdir()
    write(tmp_path / "n" / "a.csv", r, [night])  # with a byte-order mark
    lines = [",".join(turned), ",".join(str(other.get(n, "")) for n in turned)]
    (tmp_path / "n" / "b.csv").write_text("\n".join(lines) + "\n")
    want = [(night["EMAIL"], "100", "7"), (other["EMAIL"], "90", "8")]
    for paths in (str(tmp_path / "n"), [str(tmp_path / "n" / "b.csv"), str(tmp_path / "n" / "a.csv")]):
        rows = w.read_recording(spark, paths, r)
        assert rows.columns == names and sorted((x["EMAIL"], x["sleep_duration"], x["sleep_score"]) for x in rows.collect()) == sorted(want)
    (tmp_path / "n" / "c.csv").write_text(",".join(n for n in names if n != "sleep_rem") + "\n")
    with pytest.raises(ValueError, match="c.csv: .'sleep_rem'"):
        w.read_recording(spark, str(tmp_path / "n"), r)
    refused = tables.refused_files(spark, [str(tmp_path / "n")], names).collect()
    assert [(x["file"].rsplit("/", 1)[1], x["missing"]) for x in refused] == [("c.csv", ["sleep_rem"])]


def test_odd_lines_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n4,5,6\n\n")
    (tmp_path / "b.csv").write_text("y,x\n7,8\n")
    got = tables.read_by_name(spark, str(tmp_path), ["x", "y"])
    assert sorted(tuple(r) for r in got.collect()) == [("1", "2"), ("3", None), ("4", "5"), ("8", "7")]
    assert sorted(r["line"] for r in tables.odd_lines(spark, str(tmp_path), ["x", "y"]).collect()) == ["3", "4,5,6"]
    (tmp_path / "c.csv").write_text("")  # nothing to read
    assert tables.read_by_name(spark, str(tmp_path), ["x"]).count() == 4
    with pytest.raises(ValueError, match="no lines"):
        tables.read_by_name(spark, str(tmp_path / "c.csv"), ["x"])
