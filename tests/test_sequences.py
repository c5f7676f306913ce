"""Statistics within the row, whatever the batches."""

import math

import numpy as np
import pytest

from diurna.operators import sequences


def plain(seq):
    v = [x for x in seq if x is not None]
    pairs = [(a, b) for a, b in zip(seq, seq[1:]) if a is not None and b is not None]
    third = len(seq) // 3
    late, early = ([x for x in part if x is not None] for part in (seq[len(seq) - third :] if third else [], seq[:third]))
    lag = None
    if len(pairs) >= 4 and np.std([a for a, _ in pairs]) > 0 and np.std([b for _, b in pairs]) > 0:
        lag = float(np.corrcoef(*zip(*pairs, strict=True))[0, 1])
    return {
        "mean": np.mean(v) if v else None, "std": np.std(v) if v else None, "p10": np.percentile(v, 10) if v else None, "p90": np.percentile(v, 90) if v else None,
        "rmssd_adjacent": math.sqrt(np.mean([(b - a) ** 2 for a, b in pairs])) if pairs else None, "lag1": lag,
        "last_first_third": np.mean(late) - np.mean(early) if late and early else None, "valid_fraction": len(v) / len(seq) if seq else 0.0, "length": len(seq),
    }


@pytest.mark.parametrize("values", [1 << 20, 1, 7])
def test_continuous(spark, monkeypatch, values):
    monkeypatch.setattr(sequences, "VALUES", values)
    r = np.random.default_rng(1)
    rows = [(i, [None if r.random() < 0.2 else float(round(r.normal(), 2)) for _ in range(r.integers(0, 15))], f"k{i}") for i in range(40)]
    rows += [(40, None, None), (41, [], "e"), (42, [None, None], "n"), (43, [2.0] * 9, "c")]
    got = sequences.continuous_stats(spark.createDataFrame(rows, "id int, seq array<double>, `mean.x` string"), "seq", "s_").collect()
    assert len(got) == 44
    for x in got:
        for name, want in plain(rows[x["id"]][1] or []).items():
            have = x[f"s_{name}"]
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9), (x["id"], name)


def test_states_break_at_row_ends(spark):
    rows = [(1, [1.0, 1.0, None, 1.0, 2.0, 9.0, 2.0]), (2, [2.0, 2.0, 2.0]), (3, [9.0]), (4, [])]
    got = {x["id"]: x for x in sequences.state_stats(spark.createDataFrame(rows, "id int, seq array<double>"), "seq", [1, 2]).collect()}
    assert (got[1]["code_1_longest_minutes"], got[1]["code_2_longest_minutes"], got[1]["code_1_fraction"], got[1]["transition_rate"], got[1]["valid_fraction"]) == (10, 5, 0.6, 0.5, 5 / 7)
    assert (got[2]["code_2_longest_minutes"], got[2]["code_1_fraction"], got[2]["entropy"], got[2]["transition_rate"]) == (15, 0.0, 0.0, 0.0)
    assert got[3]["entropy"] is None and got[3]["length"] == 1 and got[4]["valid_fraction"] == 0.0 and got[4]["code_1_longest_minutes"] is None
