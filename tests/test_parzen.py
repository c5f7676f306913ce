import json
import math

import numpy as np
import pytest

from diurna.operators import search as s

SPACE = [
    s.Parameter("kind", "choice", options=("a", "b")),
    s.Parameter("x", "real", -5.0, 5.0, when=("kind", ("a",))),
    s.Parameter("c", "log", 1e-4, 1e2, when=("kind", ("b",))),
    s.Parameter("n", "int", 1, 9, when=("kind", ("b",))),
]


def value(p):
    if p["kind"] == "a":
        return -((p["x"] - 1.3) ** 2) - 1.0
    return -((math.log10(p["c"]) + 2.0) ** 2) - 0.1 * (p["n"] - 4) ** 2


def run(seed, trials, start):
    done = []
    for t in range(trials):
        p = s.propose(SPACE, done, seed, t, start)
        done.append((p, value(p)))
    return done


def test_only_parameters_that_hold_are_drawn_within_their_bounds():
    for p, _ in run(1, 60, 5):
        assert set(p) == ({"kind", "x"} if p["kind"] == "a" else {"kind", "c", "n"})
        assert p["kind"] == "b" or -5 <= p["x"] <= 5
        assert p["kind"] == "a" or (1e-4 <= p["c"] <= 1e2 and isinstance(p["n"], int) and 1 <= p["n"] <= 9)


def test_better_than_random_draws_on_a_known_function():
    guided = [max(v for _, v in run(seed, 50, 10)) for seed in range(12)]
    random = [max(v for _, v in run(seed, 50, 999)) for seed in range(12)]
    assert np.mean(guided) > np.mean(random) and np.median(guided) > -0.05


@pytest.mark.parametrize("parameter,seen", [(SPACE[0], ["a", "a", "b"]), (SPACE[1], [0.0, 0.1, 4.9]), (SPACE[2], [1e-4, 1.0]), (SPACE[1], [])])
def test_densities_add_up_to_one(parameter, seen):
    w = s.Windows(parameter, seen)
    if parameter.kind == "choice":
        assert abs(sum(math.exp(w.log_density(o)) for o in parameter.options) - 1) < 1e-12
    else:
        grid = np.linspace(*parameter.ends(), 20_001)
        y = [math.exp(w.log_density(math.exp(g) if parameter.kind == "log" else g)) for g in grid]
        assert abs(np.trapezoid(y, grid) - 1) < 1e-3


def test_a_search_cut_short_gives_the_same_table(spark, tmp_path):
    calls = []

    def evaluate(p):
        calls.append(p)
        if p["kind"] == "a" and p["x"] > 3:
            raise ValueError("too far")
        return value(p)

    def rows(df):
        return sorted((r.trial, r.parameters, r.status, r.objective, r.error) for r in df.collect())

    whole = rows(s.study(s.Log(spark, str(tmp_path / "w")), "one", SPACE, evaluate, 14, 3, 5))
    assert len(whole) == 14 and {r[2] for r in whole} <= {"done", "failed"} and all((r[3] is None) == (r[2] == "failed") for r in whole)
    log = s.Log(spark, str(tmp_path / "c"))

    def cut(p):
        if len(calls) >= stop:
            raise KeyboardInterrupt
        return evaluate(p)

    calls.clear()
    stop = 6
    with pytest.raises(KeyboardInterrupt):
        s.study(log, "one", SPACE, cut, 14, 3, 5)
    assert log.table().count() == 6
    calls.clear()
    assert rows(s.study(log, "one", SPACE, evaluate, 14, 3, 5)) == whole and len(calls) == 8
    calls.clear()
    assert rows(s.study(log, "one", SPACE, evaluate, 14, 3, 5)) == whole and not calls
    assert s.digest("one", json.loads(whole[0][1])) in {r.digest for r in log.table().collect()}


def test_other_errors_and_whole_failures_end_a_search(spark, tmp_path):
    def broken(p):
        raise KeyError("a fault of the program")

    def failing(p):
        raise np.linalg.LinAlgError("singular")

    with pytest.raises(KeyError):
        s.study(s.Log(spark, str(tmp_path / "a")), "x", SPACE, broken, 2, 1)
    with pytest.raises(RuntimeError, match="every trial"):
        s.study(s.Log(spark, str(tmp_path / "b")), "x", SPACE, failing, 2, 1)


def test_joint_space():
    space = s.joint_space()
    for t in range(30):
        p = s.draw(space, np.random.default_rng(t))
        assert set(p) == {"family", *(f"{p['family']}_{q.name}" for q in s.SPACES[p["family"]])}
