"""Hyper-parameter studies: a model-based sampler, a stopping rule, and a trial log that a search can resume from.

A study is an (algorithm, series) pair. What it tries next follows from its trials alone: the queue of known settings, then random
and tree-Parzen draws, then generations of an evolution strategy over the numbers, with tree-Parzen draws for the choices.
So nothing but the trial table has to be kept, all studies advance at once as groups of one job, and a search that broke off goes on
as if it had not.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquorum.operators import optimization
from tsquorum.operators.detectors import DETECTORS, Detector

#: Trials before the evolution strategy begins; the first half of them is drawn at random.
STARTUP = 50
#: Candidates of a tree-Parzen draw, and the most trials that count as good.
CANDIDATES, MOST_GOOD = 24, 25


def _numbers(detector: Detector) -> dict[str, tuple]:
    return {k: s for k, s in detector.space.items() if not isinstance(s, list)}


def _unit(value: float, space: tuple) -> float:
    low, high = space
    return float(np.clip((value - low) / (high - low), 0, 1)) if high > low else 0.5


def _from_unit(x: float, space: tuple) -> int | float:
    low, high = space
    return int(min(high, low + int(x * (high - low + 1)))) if isinstance(low, int) else float(low + x * (high - low))


# ------------------------------------------------------------------------------------------ evolution strategy


class EvolutionStrategy:
    """Covariance matrix adaptation in the unit cube, for the largest quality: mean, step size, covariance, two paths."""

    def __init__(self, mean: np.ndarray, step: float = 1 / 6) -> None:
        d = len(mean)
        self.mean, self.step, self.covariance = np.array(mean, float), step, np.eye(d)
        self.path_step, self.path_cov, self.generation = np.zeros(d), np.zeros(d), 0
        self.size = 4 + int(3 * np.log(d))
        half = self.size // 2
        w = np.log((self.size + 1) / 2) - np.log(np.arange(1, half + 1))
        self.weights = w / w.sum()
        self.effective = 1 / (self.weights**2).sum()
        m = self.effective
        self.c_step = (m + 2) / (d + m + 5)
        self.damping = 1 + 2 * max(0.0, np.sqrt((m - 1) / (d + 1)) - 1) + self.c_step
        self.c_path = (4 + m / d) / (d + 4 + 2 * m / d)
        self.c_one = 2 / ((d + 1.3) ** 2 + m)
        self.c_many = min(1 - self.c_one, 2 * (m - 2 + 1 / m) / ((d + 2) ** 2 + m))
        self.expected = np.sqrt(d) * (1 - 1 / (4 * d) + 1 / (21 * d * d))

    def _axes(self) -> tuple[np.ndarray, np.ndarray]:
        values, axes = np.linalg.eigh(self.covariance)
        return np.sqrt(np.maximum(values, 1e-16)), axes

    def ask(self, rng: np.random.Generator) -> np.ndarray:
        """A point of the cube: a few draws, then the last one is moved to the border."""
        scale, axes = self._axes()
        for _ in range(20):
            x = self.mean + self.step * axes @ (scale * rng.standard_normal(len(self.mean)))
            if ((x >= 0) & (x <= 1)).all():
                return x
        return np.clip(x, 0, 1)

    def tell(self, points: np.ndarray, quality: np.ndarray) -> None:
        """A generation's points and their qualities; of equal ones the first comes first."""
        best = points[np.argsort(-quality, kind="stable")][: len(self.weights)]
        steps = (best - self.mean) / self.step
        move = self.weights @ steps
        self.mean = self.mean + self.step * move
        self.generation += 1
        scale, axes = self._axes()
        self.path_step = (1 - self.c_step) * self.path_step + np.sqrt(self.c_step * (2 - self.c_step) * self.effective) * axes @ ((axes.T @ move) / scale)
        length = np.linalg.norm(self.path_step)
        d = len(self.mean)
        going = length / np.sqrt(1 - (1 - self.c_step) ** (2 * self.generation)) < (1.4 + 2 / (d + 1)) * self.expected
        self.path_cov = (1 - self.c_path) * self.path_cov + going * np.sqrt(self.c_path * (2 - self.c_path) * self.effective) * move
        lost = (1 - going) * self.c_path * (2 - self.c_path)
        many = (self.weights[:, None, None] * steps[:, :, None] * steps[:, None, :]).sum(axis=0)
        self.covariance = (1 - self.c_one - self.c_many + self.c_one * lost) * self.covariance + self.c_one * np.outer(self.path_cov, self.path_cov) + self.c_many * many
        self.step = float(np.clip(self.step * np.exp(self.c_step / self.damping * (length / self.expected - 1)), 1e-4, 0.5))


# ------------------------------------------------------------------------------------------ tree-Parzen draws


def _density(at: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Mixture of normal laws around ``seen``, as wide as to the farther neighbour, and a wide one in the middle; cut off at 0 and 1."""
    centres = np.sort(np.append(seen, 0.5))
    edges = np.concatenate([[0.0], centres, [1.0]])
    width = np.clip(np.maximum(centres - edges[:-2], edges[2:] - centres), 1 / min(100, 1 + len(centres)), 1.0)
    width[np.searchsorted(centres, 0.5)] = 1.0
    return (np.exp(-0.5 * ((at[:, None] - centres) / width) ** 2) / width).mean(axis=1)


def parzen_number(good: np.ndarray, bad: np.ndarray, rng: np.random.Generator) -> float:
    """Of some draws near good values the one whose density there is highest against that of bad values."""
    centres = np.append(good, 0.5)
    spread = np.append(np.full(len(good), max(0.05, 1 / (1 + len(good)))), 1.0)
    pick = rng.integers(len(centres), size=CANDIDATES)
    drawn = np.clip(centres[pick] + spread[pick] * rng.standard_normal(CANDIDATES), 0, 1)
    return float(drawn[np.argmax(_density(drawn, good) / _density(drawn, bad))])


def parzen_choice(good: Sequence, bad: Sequence, options: list, rng: np.random.Generator):
    """Likewise for choices, each counted once more than it occurs."""
    counted = lambda seen: np.array([1.0 + sum(v == o for v in seen) for o in options])
    one, two = (n / n.sum() for n in (counted(good), counted(bad)))
    drawn = rng.choice(len(options), size=CANDIDATES, p=one)
    return options[int(drawn[np.argmax(one[drawn] / two[drawn])])]


# ------------------------------------------------------------------------------------------ what a study tries


def queue_of(algorithm: str | Detector, period: int | None = None, seeds: Sequence[dict] = ()) -> list[dict]:
    """Known settings, tried first: defaults, poor defaults, defaults of the period, seeds; each once."""
    detector = DETECTORS[algorithm] if isinstance(algorithm, str) else algorithm
    listed = [dict(detector.defaults), detector.defaults | detector.bad_defaults]
    if period:
        listed.append(detector.for_period(period))
    listed += [detector.defaults | {k: v for k, v in s.items() if k in detector.defaults} for s in seeds]
    return list({json.dumps(p, sort_keys=True): p for p in listed}.values())


def suggest(algorithm: str | Detector, trials: Sequence[tuple[dict, float]], n: int, seed: int, queue: Sequence[dict] = (), startup: int = STARTUP) -> list[dict]:
    """The next ``n`` settings after ``trials`` (setting, quality) in the order of their numbers; the same for the same trials and seed.

    Trials of a round are asked for together, so they don't know of each other. Qualities that are null or not a number count as 0.
    """
    detector = DETECTORS[algorithm] if isinstance(algorithm, str) else algorithm
    space, done, numbers = detector.space, len(trials), _numbers(detector)
    quality = np.array([q if q is not None and np.isfinite(q) else 0.0 for _, q in trials])
    order = np.argsort(-quality, kind="stable")
    n_good = min(MOST_GOOD, -(-done // 10))
    good, bad = [trials[k][0] for k in order[:n_good]], [trials[k][0] for k in order[n_good:]]
    known = {name: [[_unit(p.get(name, detector.defaults.get(name, space[name][0])), space[name]) for p in side] for side in (good, bad)] for name in numbers}
    first = len(queue) + startup
    strategy = None
    if numbers and done >= first:
        points = np.array([[_unit(p.get(k, detector.defaults.get(k, s[0])), s) for k, s in numbers.items()] for p, _ in trials])
        strategy = EvolutionStrategy(points[np.argmax(quality[:first])])
        for lo in range(first, done - strategy.size + 1, strategy.size):
            strategy.tell(points[lo : lo + strategy.size], quality[lo : lo + strategy.size])
    out = []
    for number in range(done, done + n):
        if number < len(queue):
            out.append(dict(queue[number]))
            continue
        rng = np.random.default_rng([seed, number])
        drawn: dict = {}
        blind = number < len(queue) + startup // 2 or not done
        if strategy is not None and number >= first:
            drawn = {k: _from_unit(x, s) for x, (k, s) in zip(strategy.ask(rng), numbers.items(), strict=True)}
        for name, options in space.items():
            if name in drawn:
                continue
            if isinstance(options, list):
                drawn[name] = options[int(rng.integers(len(options)))] if blind else parzen_choice([p.get(name) for p in good], [p.get(name) for p in bad], options, rng)
            else:
                drawn[name] = _from_unit(rng.random() if blind else parzen_number(*map(np.array, known[name]), rng), options)
        out.append(detector.defaults | drawn)
    return out


def regret_bound(points: np.ndarray, quality: np.ndarray, seed: int = 0, n_candidates: int = 1024, most: int = 200) -> float:
    """How much better than the best trial a setting may still be: the largest upper confidence bound of a Gaussian process in
    the unit cube, less the largest lower bound at the trials. The process has a squared exponential kernel whose length and noise are
    those of a small grid with the largest marginal likelihood; it is fitted on the best ``most`` trials."""
    order = np.argsort(-quality, kind="stable")[:most]
    x, y = points[order], quality[order]
    mean, scale = y.mean(), max(y.std(), 1e-9)
    z = (y - mean) / scale
    squares = lambda a, b: ((a[:, None] - b) ** 2).sum(axis=2)
    d2, best = squares(x, x), None
    for length in (0.1, 0.2, 0.4, 0.8, 1.6):
        for noise in (1e-4, 1e-2, 1e-1):
            low = np.linalg.cholesky(np.exp(-d2 / (2 * length**2)) + (noise + 1e-8) * np.eye(len(x)))
            alpha = np.linalg.solve(low.T, np.linalg.solve(low, z))
            value = -0.5 * z @ alpha - np.log(np.diag(low)).sum()
            if best is None or value > best[0]:
                best = value, length, low, alpha
    _, length, low, alpha = best

    def bounds(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.exp(-squares(at, x) / (2 * length**2))
        spread = np.sqrt(np.maximum(1 - (np.linalg.solve(low, k.T) ** 2).sum(axis=0), 0))
        width = np.sqrt(2 * np.log(points.shape[1] * len(quality) ** 2 * np.pi**2 / 0.6) / 5) * spread
        return k @ alpha - width, k @ alpha + width

    anywhere = np.vstack([x, np.random.default_rng(seed).random((n_candidates, x.shape[1]))])
    return float(scale * (bounds(anywhere)[1].max() - bounds(x)[0].max()))


# ------------------------------------------------------------------------------------------ studies as tables


def _seed(seed: int, key: tuple) -> int:
    return zlib.crc32(repr((seed, *map(str, key))).encode())


def next_trials(studies: DataFrame, trials: DataFrame, by: list[str], n: int, seed: int = 42, startup: int = STARTUP) -> DataFrame:
    """(by.., algorithm, number, params_json): the next ``n`` trials of every study.

    ``studies`` has by.., algorithm, and may have period and seeds (array of JSON settings); ``trials`` has by.., algorithm, number,
    params_json and quality. A group per study.
    """
    keys = [*by, "algorithm"]
    has = {c for c in ("period", "seeds") if c in studies.columns}
    registered = dict(DETECTORS)  # with what was registered here, which workers don't know of

    def run(key: tuple, study: pd.DataFrame, done: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "number", "params_json"]
        if study.empty:
            return pd.DataFrame(columns=names)
        row, detector = study.iloc[0], registered[key[-1]]
        period = int(row["period"]) if "period" in has and pd.notna(row["period"]) else None
        seeds = [json.loads(s) for s in row["seeds"]] if "seeds" in has and row["seeds"] is not None else []
        done = done.sort_values(["number", "params_json"])
        listed = [(json.loads(p), q) for p, q in zip(done["params_json"], done["quality"], strict=True)]
        found = suggest(detector, listed, n, _seed(seed, key), queue_of(detector, period, seeds), startup)
        first = len(listed)
        return pd.DataFrame({**{k: [v] * len(found) for k, v in zip(keys, key, strict=True)}, "number": range(first, first + len(found)), "params_json": [json.dumps(p, sort_keys=True) for p in found]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in studies.select(*keys).schema) + ", number bigint, params_json string"
    slim = studies.select(*keys, *sorted(has))
    return slim.groupBy(*keys).cogroup(trials.select(*keys, "number", "params_json", "quality").groupBy(*keys)).applyInPandas(run, schema)


def remaining_improvement(trials: DataFrame, by: list[str], least: int = 100, seed: int = 42) -> DataFrame:
    """(by.., algorithm, n, bound): the regret bound of studies with at least ``least`` trials, null for others."""
    keys = [*by, "algorithm"]
    registered = dict(DETECTORS)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, numbers, bound = rows.sort_values(["number", "params_json"]), _numbers(registered[key[-1]]), None
        if len(rows) >= least and numbers:
            defaults = registered[key[-1]].defaults
            points = np.array([[_unit(p.get(k, defaults.get(k, s[0])), s) for k, s in numbers.items()] for p in map(json.loads, rows["params_json"])])
            bound = regret_bound(points, rows["quality"].fillna(0).to_numpy(float), _seed(seed, key))
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "n": [len(rows)], "bound": [bound]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trials.select(*keys).schema) + ", n bigint, bound double"
    return trials.select(*keys, "number", "params_json", "quality").groupBy(*keys).applyInPandas(run, schema)


def statuses(trials: DataFrame, by: list[str], max_trials: int = 800, quality: float = 0.95, enough: int = 10, static_error: float = 0.02, least: int = 100) -> DataFrame:
    """(by.., algorithm, n_completed, best_score, status): good enough, all trials done, no improvement left to hope for, or active."""
    keys = [*by, "algorithm"]
    per = trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_completed"), F.max("quality").alias("best_score"), F.count_if(F.col("quality") >= quality).alias("_good"))
    joined = per.join(remaining_improvement(trials, by, least).select(*keys, "bound"), keys)
    status = F.when(F.col("_good") >= enough, "max_quality").when(F.col("n_completed") >= max_trials, "max_trials").when(F.col("bound") < static_error, "terminated").otherwise("active")
    return joined.select(*keys, "n_completed", "best_score", status.alias("status"))


class TrialLog:
    """Trials in a folder, a round a table; a round counts once its table is complete (its marker is there).

    Reading is a snapshot of the complete rounds; a round that broke off is written anew. One search writes at a time.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def rounds(self) -> int:
        n = 0
        while self._exists(f"{self.folder}/round={n}/_SUCCESS"):
            n += 1
        return n

    def read(self, rounds: int | None = None) -> DataFrame | None:
        """All trials of the complete rounds (or the first so many) with their round; None if there are none."""
        n = self.rounds() if rounds is None else rounds
        return self.spark.read.option("basePath", self.folder).parquet(*[f"{self.folder}/round={k}" for k in range(n)]) if n else None

    def append(self, trials: DataFrame) -> None:
        trials.write.mode("overwrite").parquet(f"{self.folder}/round={self.rounds()}")

    def closed(self, rounds: int) -> DataFrame | None:
        """Studies closed before a round, with their status; None before the second round."""
        return self.spark.read.parquet(f"{self.folder}/closed-{rounds}") if rounds else None

    def close(self, rounds: int, studies: DataFrame) -> DataFrame:
        studies.write.mode("overwrite").parquet(f"{self.folder}/closed-{rounds}")
        return self.closed(rounds)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; under a local master without that setting, one that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tsquorum-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/tsquorum/{kind}-{uuid.uuid4().hex}"


def run_studies(
    series: DataFrame, studies: DataFrame, by: list[str], log: TrialLog, rounds: int, per_round: int, *, metric: str = "RangePrAUC", seed: int = 42,
    startup: int = STARTUP, max_trials: int = 800, quality: float = 0.95, enough: int = 10, prune: bool = True, run: Callable[..., DataFrame] = optimization.run_trials,
) -> DataFrame:
    """Advances all studies of labelled ``series`` by up to ``rounds`` rounds in all and returns the log's trials.

    Rounds that the log holds aren't run again, nor are settings that a series has had: those take the quality it had. After each
    round studies stop by ``statuses``, and with ``prune`` the worst algorithm of each series. Ends early when no study is open.
    """
    keys = [*by, "algorithm"]
    empty = series.sparkSession.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in studies.select(*keys).schema) + ", number bigint, params_json string, quality double, duration double")
    for k in range(log.rounds(), rounds):
        done = log.read(k)
        seen = empty if done is None else done.select(*empty.columns)
        wanted = studies
        if done is not None:
            state, before = statuses(done, by, max_trials, quality, enough), log.closed(k - 1)
            if before is not None:
                state = state.join(before, keys, "left_anti")
            if prune:
                state = optimization.prune_worst(state.withColumn("dataset", F.to_json(F.struct(*by))))
            ended = state.where("status <> 'active'").select(*keys, "status")
            wanted = studies.join(log.close(k, ended if before is None else ended.unionByName(before)), keys, "left_anti")
        asked = next_trials(wanted, seen, by, per_round, seed, startup)
        known = seen.groupBy(*keys, "params_json").agg(F.first("quality").alias("quality"), F.lit(0.0).alias("duration"))
        ran = run(series, asked.join(known, [*keys, "params_json"], "left_anti").select(*keys, "params_json"), by, metric)
        got = known.unionByName(ran.select(*known.columns))
        log.append(asked.join(got, [*keys, "params_json"]).select(*empty.columns))
        if log.read(k + 1).where(F.col("round") == k).isEmpty():
            break
    found = log.read()
    return empty if found is None else found
