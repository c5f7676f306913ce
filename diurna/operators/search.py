"""Parameter search guided by earlier trials, over spaces that depend on what is drawn.

A space is a list of parameters; one may hold only where another has a certain
value.  After some random trials, each next one comes from two densities of
Parzen windows, one over the good trials and one over the rest: of some draws
from the first the one most likely under it, compared with the second, is
tried.  Trials are rows of a table; a search goes on from the rows it finds.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Failures that are a trial's result; any other error ends the search.
FAILURES = (ValueError, RuntimeError, np.linalg.LinAlgError)
TRIALS = "study string, trial int, digest string, parameters string, status string, objective double, error string"


@dataclass(frozen=True)
class Parameter:
    """A parameter: ``kind`` choice (``options``), real, log or int (``low`` to ``high``).  ``when``: what else must have been drawn."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 0.0
    options: tuple = ()
    when: tuple[str, tuple] | None = None

    def holds(self, drawn: dict) -> bool:
        return self.when is None or drawn.get(self.when[0]) in self.when[1]

    def inner(self, value: float) -> float:
        """A number on the scale that windows live on."""
        return math.log(value) if self.kind == "log" else float(value)

    def outer(self, x: float):
        """Back from there, within the bounds."""
        if self.kind == "int":
            return int(min(self.high, max(self.low, round(x))))
        return float(min(self.high, max(self.low, math.exp(x) if self.kind == "log" else x)))

    def ends(self) -> tuple[float, float]:
        low, high = self.inner(self.low), self.inner(self.high)
        return (low - 0.5, high + 0.5) if self.kind == "int" else (low, high)


def draw(space: Sequence[Parameter], rng: np.random.Generator) -> dict:
    """One random point of a space, parameter by parameter in its order."""
    out: dict = {}
    for p in space:
        if p.holds(out):
            out[p.name] = p.options[int(rng.integers(len(p.options)))] if p.kind == "choice" else p.outer(rng.uniform(*p.ends()))
    return out


class Windows:
    """A density of Parzen windows over values seen, mixed with the flat one as one more value."""

    def __init__(self, parameter: Parameter, seen: Sequence) -> None:
        self.p = parameter
        if parameter.kind == "choice":
            counts = np.array([1.0 / len(parameter.options) + sum(v == o for v in seen) for o in parameter.options])
            self.shares = counts / counts.sum()
            return
        self.low, self.high = parameter.ends()
        self.centres = np.sort([parameter.inner(v) for v in seen])
        if len(self.centres):
            # a window reaches to its farther neighbour, no less than a share of the range that shrinks with trials
            around = np.diff(np.concatenate([[self.low], self.centres, [self.high]]))
            least = (self.high - self.low) / min(100.0, 1.0 + len(self.centres))
            self.widths = np.clip(np.maximum(around[:-1], around[1:]), least, self.high - self.low)

    def sample(self, rng: np.random.Generator):
        if self.p.kind == "choice":
            return self.p.options[int(rng.choice(len(self.p.options), p=self.shares))]
        i = int(rng.integers(len(self.centres) + 1))
        if i == len(self.centres):
            return self.p.outer(rng.uniform(self.low, self.high))
        for _ in range(100):
            x = rng.normal(self.centres[i], self.widths[i])
            if self.low <= x <= self.high:
                return self.p.outer(x)
        return self.p.outer(self.centres[i])

    def log_density(self, value) -> float:
        if self.p.kind == "choice":
            return float(np.log(self.shares[self.p.options.index(value)]))
        x = self.p.inner(value)
        total = 1.0 / (self.high - self.low)
        for c, w in zip(self.centres, self.widths, strict=True) if len(self.centres) else ():
            inside = 0.5 * (math.erf((self.high - c) / (w * math.sqrt(2))) - math.erf((self.low - c) / (w * math.sqrt(2))))
            total += math.exp(-0.5 * ((x - c) / w) ** 2) / (w * math.sqrt(2 * math.pi)) / inside
        return math.log(total / (len(self.centres) + 1))


def propose(space: Sequence[Parameter], done: Sequence[tuple[dict, float]], seed: int, trial: int, start: int = 10, candidates: int = 24) -> dict:
    """What trial number ``trial`` tries, given parameters and objectives of those before it; larger is better.

    The best tenth of the trials, one at least and 25 at most, are the good
    ones.  A parameter's densities come from the trials in which it held.  The
    same trials give the same proposal, so a search cut short goes on as it
    would have.
    """
    rng = np.random.default_rng([seed, trial])
    if len(done) < start:
        return draw(space, rng)
    ranked = sorted(range(len(done)), key=lambda i: (-done[i][1], i))
    n = min(25, max(1, math.ceil(0.1 * len(done))))
    good, rest = ([done[i][0] for i in part] for part in (ranked[:n], ranked[n:]))
    out: dict = {}
    for p in space:
        if not p.holds(out):
            continue
        near, far = (Windows(p, [d[p.name] for d in part if p.name in d]) for part in (good, rest))
        tried = [near.sample(rng) for _ in range(candidates)]
        out[p.name] = max(tried, key=lambda v: near.log_density(v) - far.log_density(v))
    return out


def digest(study: str, parameters: dict) -> str:
    return hashlib.sha256(json.dumps([study, parameters], sort_keys=True).encode()).hexdigest()


class Log:
    """Trials of searches as a table in a folder that all machines share; rows are only ever added."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self) -> DataFrame:
        """All trials so far: those of one digest once, as first written."""
        try:
            rows = self.spark.read.schema(TRIALS).parquet(f"{self.folder}/trial=*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TRIALS)
        return rows.dropDuplicates(["study", "trial"])

    def add(self, row: tuple) -> None:
        self.spark.createDataFrame([row], TRIALS).coalesce(1).write.parquet(f"{self.folder}/trial={uuid.uuid4().hex}")


def study(log: Log, name: str, space: Sequence[Parameter], evaluate: Callable[[dict], float], trials: int, seed: int, start: int = 10) -> DataFrame:
    """Search ``space`` for the largest ``evaluate(parameters)``: this study's rows of the log, by trial.

    A trial that fails in one of ``FAILURES`` is a row with its error.  Trials
    in the log aren't run again; parameters tried before take their earlier
    objective.  If every trial failed, the search is an error.
    """
    rows = [r for r in log.table().filter(F.col("study") == name).orderBy("trial").collect() if r["trial"] < trials]  # a row for each trial
    known = {r["digest"]: r for r in rows}
    done = {r["trial"]: (json.loads(r["parameters"]), r["objective"]) for r in rows if r["status"] == "done"}
    seen = {r["trial"] for r in rows}
    for t in range(trials):
        if t in seen:
            continue
        values = propose(space, [done[i] for i in sorted(done) if i < t], seed, t, start)
        key = digest(name, values)
        status, objective, error = "done", None, None
        if key in known:
            status, objective, error = known[key]["status"], known[key]["objective"], known[key]["error"]
        else:
            try:
                objective = float(evaluate(values))
            except FAILURES as e:
                status, error = "failed", f"{type(e).__name__}: {e}"[:500]
        row = (name, t, key, json.dumps(values, sort_keys=True), status, objective, error)
        log.add(row)
        known.setdefault(key, {"status": status, "objective": objective, "error": error})
        if status == "done":
            done[t] = (values, objective)
    if not done and trials:
        raise RuntimeError(f"every trial of {name} failed")
    return log.table().filter((F.col("study") == name) & (F.col("trial") < trials))


# What a search of boosted trees or extra trees may try.
SPACES: dict[str, list[Parameter]] = {
    "histgb": [
        Parameter("rounds", "choice", options=(2, 4, 6)),
        Parameter("leaves", "choice", options=(3, 7, 15)),
        Parameter("least", "int", 3, 20),
        Parameter("rate", "log", 0.02, 0.5),
        Parameter("strength", "log", 0.1, 100.0),
    ],
    "extratrees": [
        Parameter("depth", "choice", options=(3, 5, 8)),
        Parameter("least", "int", 1, 10),
        Parameter("trees", "choice", options=(5, 10)),
    ],
}


def joint_space(families: Sequence[str] = tuple(SPACES)) -> list[Parameter]:
    """One space of all families: each family's parameters hold where it is drawn."""
    out = [Parameter("family", "choice", options=tuple(families))]
    for f in families:
        out += [Parameter(f"{f}_{p.name}", p.kind, p.low, p.high, p.options, ("family", (f,))) for p in SPACES[f]]
    return out
