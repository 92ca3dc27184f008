"""Parameter search: adaptive sampling, and trials that are stopped below the median.

Every parameter is a function of a number between 0 and 1, so the sampler works on those numbers
whatever the parameter's scale. Trials run as Spark jobs; the table of trials is small and stays on the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from hashlib import md5
from statistics import median
from threading import Lock

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.plans.network import NetworkSettings, TrainedNetwork, train_network
from assayloom.session import constant_table
from assayloom.settings import RANDOM_SEED

Space = dict[str, Callable[[Column], Column]]
Units = dict[str, float]


def hash_unit(trial: int, name: str, seed: int) -> float:
    """The number that ``draw_trials`` draws for this trial and parameter."""
    return int(md5(f"{trial}|{name}|{seed}".encode()).hexdigest()[:12], 16) / 16**12


@dataclass(frozen=True)
class AdaptiveSampler:
    """Draws where good trials lie denser than the others.

    Past trials are parted by score: the best ``share`` of them are good. For each parameter both parts
    give a density on [0, 1], a bump for each trial over an even ground. Candidates are drawn from the
    good density, and the one with the highest ratio of good to other density is tried. The first
    ``startup`` trials are random; the draws depend on the seed, the trial number and the scores.
    """

    startup: int = 10
    share: float = 0.25
    candidates: int = 24
    seed: int = RANDOM_SEED

    def _width(self, centres: np.ndarray) -> float:
        return max(0.04, 0.6 / (1 + len(centres)))

    def _density(self, at: np.ndarray, centres: np.ndarray) -> np.ndarray:
        width = self._width(centres)
        erf = np.vectorize(math.erf, otypes=[float])
        mass = 0.5 * (erf((1 - centres) / width / math.sqrt(2)) - erf(-centres / width / math.sqrt(2)))
        bumps = np.exp(-0.5 * ((at[:, None] - centres) / width) ** 2) / (width * math.sqrt(2 * math.pi) * mass)
        return (1 + bumps.sum(1)) / (1 + len(centres))

    def _drawn(self, rng, centres: np.ndarray) -> np.ndarray:
        width, out = self._width(centres), rng.random(self.candidates)
        for i, pick in enumerate(rng.integers(0, len(centres) + 1, self.candidates)):
            while pick < len(centres):  # else the even ground
                out[i] = rng.normal(centres[pick], width)
                if 0 <= out[i] < 1:
                    break
        return out

    def propose(
        self, names: Sequence[str], past: Sequence[tuple[Units, float]], trial: int,
        running: Sequence[Units] = (),
    ) -> Units:
        """Units of the next trial. ``past`` has the scores, lower is better, infinite for failures; trials
        still ``running`` count among the others, so trials of one batch keep apart."""
        if len(past) < self.startup:
            return {n: hash_unit(trial, n, self.seed) for n in names}
        ranked = [u for u, _ in sorted(past, key=lambda p: p[1])]
        n_good = max(1, math.ceil(self.share * len(ranked)))
        good, others = ranked[:n_good], [*ranked[n_good:], *running]
        rng = np.random.default_rng([self.seed, trial])
        ratio, drawn = np.zeros(self.candidates), {}
        for name in names:
            g, o = (np.array([u[name] for u in part]) for part in (good, others))
            drawn[name] = self._drawn(rng, g)
            ratio += np.log(self._density(drawn[name], g)) - np.log(self._density(drawn[name], o))
        best = int(ratio.argmax())
        return {n: float(v[best]) for n, v in drawn.items()}


@dataclass
class MedianPruner:
    """Stops a trial whose best value so far is worse than the median of finished trials at its step.

    Nothing is stopped before ``startup`` trials have finished, nor in the first ``warmup`` steps.
    """

    startup: int = 5
    warmup: int = 10
    _values: dict[int, dict[int, float]] = field(default_factory=dict)
    _finished: set[int] = field(default_factory=set)
    _lock: Lock = field(default_factory=Lock)

    def stops(self, trial: int, step: int, value: float) -> bool:
        with self._lock:
            own = self._values.setdefault(trial, {})
            own[step] = value
            others = [self._values[t][step] for t in self._finished if step in self._values.get(t, {})]
            if step < self.warmup or len(self._finished) < self.startup or not others:
                return False
            return not min(own.values()) <= median(others)

    def finish(self, trial: int) -> None:
        with self._lock:
            self._finished.add(trial)

    def steps(self, trial: int) -> int:
        return len(self._values.get(trial, {}))


@dataclass(frozen=True)
class Trial:
    number: int
    params: dict
    score: float
    steps: int
    pruned: bool
    reason: str | None = None


def _params(spark: SparkSession, space: Space, units: Sequence[Units]) -> list[dict]:
    """Parameters of each trial: the space's columns over a table of units."""
    table = constant_table(spark, {
        "_at": ("int", list(range(len(units)))),
        **{f"_u_{n}": ("double", [u[n] for u in units]) for n in space},
    })
    rows = table.orderBy("_at").select(*[draw(F.col(f"_u_{n}")).alias(n) for n, draw in space.items()])
    return [r.asDict() for r in rows.collect()]


def search(
    spark: SparkSession, space: Space, objective: Callable[[dict, Callable[[int, float], bool]], float],
    n_trials: int = 20, sampler: AdaptiveSampler | None = None, pruner: MedianPruner | None = None,
    parallelism: int = 4,
) -> list[Trial]:
    """Runs trials in batches of ``parallelism``; every batch is drawn from all results before it.

    ``objective(params, report)`` gives the score, lower is better; ``report(step, value)`` is true if the
    trial should stop. A ValueError or TypeError gives the trial an infinite score and its reason.
    """
    sampler, pruner = sampler or AdaptiveSampler(), pruner or MedianPruner(startup=n_trials + 1)
    past: list[tuple[Units, float]] = []
    out: list[Trial] = []

    def run(number: int, params: dict) -> Trial:
        stopped = []

        def report(step: int, value: float) -> bool:
            stopped[:] = [pruner.stops(number, step, value)]
            return stopped[0]

        try:
            score, reason = float(objective(params, report)), None
        except (ValueError, TypeError) as error:
            score, reason = math.inf, str(error)
        pruned = bool(stopped and stopped[0])
        if not pruned and reason is None:
            pruner.finish(number)
        return Trial(number, params, score if score == score else math.inf, pruner.steps(number), pruned, reason)

    while len(out) < n_trials:
        units: list[Units] = []
        for number in range(len(out), min(n_trials, len(out) + parallelism)):
            units.append(sampler.propose(list(space), past, number, units))
        drawn = _params(spark, space, units)
        with ThreadPoolExecutor(parallelism) as pool:
            done = list(pool.map(run, range(len(out), len(out) + len(units)), drawn))
        past += [(u, t.score) for u, t in zip(units, done)]
        out += done
    if all(t.reason for t in out):
        raise ValueError(f"every trial failed, the first one with: {out[0].reason}")
    return out


def trial_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """(trial, score, steps, pruned, reason)."""
    return constant_table(spark, {
        "trial": ("bigint", [t.number for t in trials]),
        "score": ("double", [t.score for t in trials]),
        "steps": ("int", [t.steps for t in trials]),
        "pruned": ("boolean", [t.pruned for t in trials]),
        "reason": ("string", [t.reason for t in trials]),
    })


def network_space(log_uniform, uniform, integer, choice) -> Space:
    """Rate, dropout, decay, number and width of layers of the network."""
    return {
        "rate": log_uniform(1e-5, 3e-4), "dropout": uniform(0.05, 0.3), "decay": log_uniform(1e-6, 1e-4),
        "layers": integer(2, 4), "width": choice(128, 256, 512),
    }


def network_search(
    df: DataFrame, features: str, label: str, key: str, space: Space, n_trials: int = 20,
    settings: NetworkSettings | None = None, sampler: AdaptiveSampler | None = None,
    pruner: MedianPruner | None = None, parallelism: int = 2,
) -> tuple[TrainedNetwork, list[Trial]]:
    """Searches the network's settings by the validation loss of its best epoch, stops trials below the
    median, and trains the best one again to its end."""
    settings = settings or NetworkSettings()

    def of(params: dict) -> NetworkSettings:
        own = dict(params)
        layers, width = own.pop("layers", None), own.pop("width", None)
        if layers or width:
            own["hidden"] = (width or settings.hidden[0],) * (layers or len(settings.hidden))
        return replace(settings, **own)

    def objective(params: dict, report) -> float:
        made = train_network(df, features, label, key, of(params), report=report)
        return min(loss for _, _, loss in made.history)

    trials = search(df.sparkSession, space, objective, n_trials, sampler,
                    pruner or MedianPruner(), parallelism)
    best = min((t for t in trials if not t.pruned), key=lambda t: (t.score, t.number))
    return train_network(df, features, label, key, of(best.params)), trials
