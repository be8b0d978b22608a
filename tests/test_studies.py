"""Sampler, stopping rule and trial log."""

from __future__ import annotations

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tsquorum.operators import detectors, optimization, studies
from tsquorum.plans import kernel_queries, registry

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


@pytest.fixture(scope="module", autouse=True)
def made_up():
    """A detector that is only a search space."""
    space = {"a": (0.0, 1.0), "b": (0.0, 10.0), "c": (1, 100), "d": (0.0, 1.0), "kind": ["x", "y", "z"]}
    detectors.register("made_up", detectors.Detector(lambda x, p, r: x, {"a": 0.9, "b": 9.0, "c": 90, "d": 0.1, "kind": "x"}, space, {"a": 1.0}))
    yield
    del detectors.DETECTORS["made_up"]


def goodness(p: dict) -> float:
    off = (p["a"] - 0.3) ** 2 + (p["b"] / 10 - 0.6) ** 2 + ((p["c"] - 20) / 100) ** 2 + (p["d"] - 0.7) ** 2
    return float(np.exp(-3 * off)) * (1.0 if p["kind"] == "z" else 0.8)


def searched(seed: int, rounds: int = 25, n: int = 8) -> list[tuple[dict, float]]:
    trials: list[tuple[dict, float]] = []
    for _ in range(rounds):
        trials += [(p, goodness(p)) for p in studies.suggest("made_up", trials, n, seed, studies.queue_of("made_up"), startup=30)]
    return trials


def test_strategy_climbs():
    rng, strategy = np.random.default_rng(1), studies.EvolutionStrategy(np.full(6, 0.5))
    goal = np.array([0.2, 0.8, 0.5, 0.1, 0.9, 0.4])
    for _ in range(150):
        points = np.array([strategy.ask(rng) for _ in range(strategy.size)])
        strategy.tell(points, -(((points - goal) * [1, 5, 1, 3, 1, 1]) ** 2).sum(axis=1))
    assert np.abs(strategy.mean - goal).max() < 1e-2 and strategy.step < 0.02


def test_search_beats_random_settings_and_repeats_itself():
    for seed in (1, 2, 3):
        found = searched(seed)
        blind = max(goodness(p) for p in optimization.proposals("made_up", 198, seed))
        assert len(found) == 200 and max(q for _, q in found) > blind
        assert max(q for _, q in found) > 0.97
    assert searched(3, 10) == found[:80]


def test_settings_lie_in_the_space_and_the_queue_comes_first():
    found = [p for p, _ in searched(4, 12)]
    assert found[:2] == [detectors.DETECTORS["made_up"].defaults, detectors.DETECTORS["made_up"].defaults | {"a": 1.0}]
    assert all(0 <= p["a"] <= 1 and 0 <= p["b"] <= 10 and 1 <= p["c"] <= 100 and isinstance(p["c"], int) and p["kind"] in "xyz" for p in found)
    known = studies.queue_of("kmeans", 30, [{"n_clusters": 7, "other": 1}, {"n_clusters": 7}])
    assert [p["window_size"] for p in known] == [100, 20, 30, 100] and known[3]["n_clusters"] == 7
    odd = [({}, None), ({"a": 2.0}, float("nan")), ({"a": 0.5, "kind": "q"}, 0.4)]
    assert len(studies.suggest("made_up", odd, 3, 1, startup=1)) == 3


def test_bound_falls_where_nothing_is_left_to_find():
    rng = np.random.default_rng(5)
    few, many = rng.random((8, 2)), rng.random((150, 2))
    law = lambda x: np.exp(-4 * ((x - 0.4) ** 2).sum(axis=1))
    assert studies.regret_bound(many, law(many)) < 0.02 < studies.regret_bound(few, law(few))
    assert studies.regret_bound(many, np.full(150, 0.5)) < 0.02


def fake(series, jobs, by, metric="RangePrAUC"):
    """Quality from the settings alone."""
    from pyspark.sql.types import DoubleType

    return jobs.distinct().select(*by, "algorithm", "params_json", F.udf(lambda s: goodness(json.loads(s)), DoubleType())("params_json").alias("quality"), F.lit(0.1).alias("duration"))


def test_a_search_that_broke_off_goes_on_as_if_it_had_not(spark, tmp_path):
    series = spark.createDataFrame([(i, 0, 1.0, False) for i in range(2)], "series_id int, t bigint, value double, is_anomaly boolean")
    wanted = series.select("series_id").withColumn("algorithm", F.lit("made_up"))
    calls = []

    def breaks(series, jobs, by, metric="RangePrAUC"):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return fake(series, jobs, by)

    run = lambda folder, how: studies.run_studies(series, wanted, ["series_id"], studies.TrialLog(spark, str(tmp_path / folder)), 4, 3, startup=4, run=how, prune=False)
    with pytest.raises(RuntimeError):
        run("one", breaks)
    assert studies.TrialLog(spark, str(tmp_path / "one")).rounds() == 2
    listed = lambda df: sorted(map(tuple, df.select("series_id", "round", "number", "params_json", "quality").collect()))
    resumed, whole = listed(run("one", breaks)), listed(run("two", fake))
    assert resumed == whole and len(whole) == 24 and len(calls) == 5
    assert {r[2] for r in whole} == set(range(12))


def test_worst_algorithm_stops_and_known_settings_are_not_run_again(spark, tmp_path):
    series = spark.createDataFrame([(0, 0, 1.0, False)], "series_id int, t bigint, value double, is_anomaly boolean")
    wanted = series.select("series_id").withColumn("algorithm", F.explode(F.array(F.lit("made_up"), F.lit("stomp"), F.lit("kmeans"))))
    asked = []

    def level(series, jobs, by, metric="RangePrAUC"):
        asked.append(jobs.count())
        score = F.when(F.col("algorithm") == "made_up", 0.5).when(F.col("algorithm") == "stomp", 0.3).otherwise(0.2)
        return jobs.distinct().select(*by, "algorithm", "params_json", score.alias("quality"), F.lit(0.0).alias("duration"))

    found = studies.run_studies(series, wanted, ["series_id"], studies.TrialLog(spark, str(tmp_path)), 3, 2, startup=2, run=level)
    n = {r["algorithm"]: r["count"] for r in found.groupBy("algorithm").count().collect()}
    assert n == {"made_up": 6, "stomp": 4, "kmeans": 2} and sum(asked) <= 12
    state = {r["algorithm"]: r["status"] for r in studies.statuses(found, ["series_id"], max_trials=6).collect()}
    assert state == {"made_up": "max_trials", "stomp": "active", "kmeans": "active"}


def test_queries_equal_the_plain_functions(spark, sf_dir):
    trials = kernel_queries._cluster_trials(spark, sf_dir)
    listed: dict = {}
    for r in trials.orderBy("dataset", "number").collect():
        listed.setdefault(r["dataset"], []).append((json.loads(r["params_json"]), r["quality"]))
    got: dict = {}
    for r in registry.QUERIES["o2_next_trials"](spark, sf_dir).orderBy("dataset", "number").collect():
        got.setdefault(r["dataset"], []).append((r["number"], r["window_size"], r["n_clusters"]))
    for dataset, done in listed.items():
        plain = studies.suggest("kmeans", done, 4, studies._seed(42, (dataset, "kmeans")), studies.queue_of("kmeans"), 4)
        assert got[dataset] == [(len(done) + k, p["window_size"], p["n_clusters"]) for k, p in enumerate(plain)]
    assert len(got) == len(listed)
    rounds = registry.QUERIES["o3_study_rounds"](spark, sf_dir).collect()
    assert {r["round"] for r in rounds} == {0, 1} and all(0 <= r["quality"] <= 1 for r in rounds)
