"""Hyper-parameter search as tables: states of (algorithm, dataset) pairs and trials, advanced round by round.

state: (algorithm, dataset, status, n_completed, n_desired, best_score). trials: (algorithm, dataset, params
map<string,double>, quality, duration).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsquorum.functions.scalar import binned_map, canonical_params
from tsquorum.operators.detectors import DETECTORS, execute
from tsquorum.operators.metrics import METRICS

#: The states of a search.
STATUSES = ("active", "max_trials", "max_quality", "terminated", "algo_pruned", "dataset_pruned", "error")


def open_searches(state: DataFrame) -> DataFrame:
    return state.where("status = 'active' and n_desired > n_completed")


def stopped(state: DataFrame, trials: DataFrame, max_trials: int = 800, quality: float = 0.95, enough: int = 10, static_error: float = 0.02, least_trials: int = 100) -> DataFrame:
    """New statuses: enough good trials, all trials done, or the last trials' best no better by the static error."""
    order = Window.partitionBy("algorithm", "dataset").orderBy("trial")
    best = F.max("quality").over(order.rowsBetween(Window.unboundedPreceding, 0))
    seen = trials.withColumn("_best", best).withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("algorithm", "dataset")))
    per = seen.groupBy("algorithm", "dataset").agg(
        F.count_if(F.col("quality") >= quality).alias("_good"), F.max("quality").alias("_top"), F.max(F.when(F.col("_n") <= F.col("_all") * 0.8, F.col("_best"))).alias("_before"), F.max("_all").alias("_all"))
    joined = state.join(per, ["algorithm", "dataset"], "left")
    new = (
        F.when(F.col("status") != "active", F.col("status")).when(F.coalesce("_good", F.lit(0)) >= enough, "max_quality").when(F.col("n_completed") >= max_trials, "max_trials")
        .when((F.col("_all") >= least_trials) & (F.col("_top") - F.col("_before") < static_error), "terminated").otherwise("active")
    )
    return joined.withColumn("status", new).select(*state.columns)


def prune_worst(state: DataFrame) -> DataFrame:
    """Per dataset the worst active algorithm is pruned, where more than one is active."""
    active = Window.partitionBy("dataset", F.col("status") == "active")
    worst = F.row_number().over(active.orderBy(F.col("best_score"), "algorithm")) == 1
    many = F.count(F.lit(1)).over(active) > 1
    return state.withColumn("status", F.when((F.col("status") == "active") & worst & many, "algo_pruned").otherwise(F.col("status")))


def best_algorithms(state: DataFrame) -> DataFrame:
    """The best algorithm per dataset, of those not pruned; ties by name."""
    order = Window.partitionBy("dataset").orderBy(F.col("best_score").desc(), "algorithm")
    return state.where("status <> 'algo_pruned'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_instances(trials: DataFrame, winners: DataFrame) -> DataFrame:
    """(algorithm, params, no_datasets) of the best trial per dataset won, by binned parameters."""
    order = Window.partitionBy("algorithm", "dataset").orderBy(F.col("quality").desc(), canonical_params(F.col("params")))
    best = trials.join(winners.select("algorithm", "dataset"), ["algorithm", "dataset"], "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    keyed = best.withColumn("params_id", F.md5(canonical_params(binned_map(F.col("params")))))
    return keyed.groupBy("algorithm", "params_id").agg(F.min_by("params", "dataset").alias("params"), F.countDistinct("dataset").alias("no_datasets"))


def with_defaults(instances: DataFrame, defaults: DataFrame) -> DataFrame:
    """Adds default parameters of each algorithm where they are absent, with no_datasets 0."""
    keyed = defaults.withColumn("params_id", F.md5(canonical_params(binned_map(F.col("params")))))
    missing = keyed.join(instances.select("algorithm", "params_id"), ["algorithm", "params_id"], "left_anti")
    return instances.unionByName(missing.select("algorithm", "params_id", "params", F.lit(0).cast("long").alias("no_datasets")))


def binned_common(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of ``two`` whose binned parameters ``one`` has too."""
    key = lambda df: df.withColumn("_k", canonical_params(binned_map(F.col("params"))))
    return key(two).join(key(one).select("_k").distinct(), "_k", "left_semi").drop("_k")


def tolerant_common(one: DataFrame, two: DataFrame, key: str = "v", tolerance: float = 1e-6) -> DataFrame:
    """Rows of ``two`` within a tolerance of one of ``one``: equal bins or neighbouring ones, then the exact test."""
    cell = lambda c: F.floor(c / F.lit(2 * tolerance)).cast("long")
    near = one.select(F.col(key).alias("_o"), F.explode(F.array(cell(F.col(key)) - 1, cell(F.col(key)), cell(F.col(key)) + 1)).alias("_c"))
    on = (cell(F.col(key)) == F.col("_c")) & (F.abs(F.col(key) - F.col("_o")) <= tolerance)
    return two.join(near, on, "left_semi")


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of training series that agree in at least two of base, anomaly type and length."""
    same = sum((F.col(f"a.{c}") == F.col(f"b.{c}")).cast("int") for c in ("base", "anomaly_type", "length"))
    return a.alias("a").join(b.alias("b"), F.col("a.dataset") < F.col("b.dataset")).where(same >= 2).select(F.col("a.dataset").alias("i"), F.col("b.dataset").alias("j"))


def consolidated(trials: DataFrame, epsilon: float = 0.02, threshold: float = 0.9) -> DataFrame:
    """(algorithm, params_id, datasets): settings that are good on several datasets, without those whose datasets
    another setting of the algorithm covers too. Good: near the best of the dataset, or above a threshold."""
    best = F.max("quality").over(Window.partitionBy("algorithm", "dataset"))
    good = trials.withColumn("_b", best).where((F.col("quality") >= F.col("_b") - epsilon) | (F.col("quality") >= threshold))
    keyed = good.withColumn("params_id", F.md5(canonical_params(binned_map(F.col("params")))))
    sets = keyed.groupBy("algorithm", "params_id").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"), F.avg("quality").alias("mean_quality")).where(F.size("datasets") > 1)
    other = sets.select("algorithm", F.col("params_id").alias("_p"), F.col("datasets").alias("_d"), F.col("mean_quality").alias("_q"))
    bigger = (F.size("_d") > F.size("datasets")) | ((F.size("_d") == F.size("datasets")) & ((F.col("_q") > F.col("mean_quality")) | ((F.col("_q") == F.col("mean_quality")) & (F.col("_p") < F.col("params_id")))))
    covered = sets.join(other, "algorithm").where((F.col("params_id") != F.col("_p")) & bigger & (F.size(F.array_except("datasets", "_d")) == 0)).select("algorithm", "params_id").distinct()
    return sets.join(covered, ["algorithm", "params_id"], "left_anti")


def final_order(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``position`` from 0: settings best on most series first, then by mean quality, then by name."""
    order = Window.partitionBy(*by).orderBy(F.col("no_datasets").desc(), F.col("mean_train_quality").desc(), "algorithm", "params_json")
    return candidates.withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def resolve_proxies(state: DataFrame, results: DataFrame, deviation: float = 0.05) -> DataFrame:
    """Datasets pruned in favour of a proxy take the proxy's result where it is at most ``deviation`` worse."""
    joined = state.join(results.select("algorithm", "dataset", F.col("quality").alias("_q")), ["algorithm", "dataset"], "left")
    accept = (F.col("status") == "dataset_pruned") & F.col("_q").isNotNull() & (F.col("_q") >= F.col("best_score") - deviation)
    return joined.withColumn("best_score", F.when(accept, F.col("_q")).otherwise(F.col("best_score"))).drop("_q")


def proposals(algorithm: str, n: int, seed: int) -> list[dict]:
    """Defaults, poor defaults, then ``n`` random settings from the search space; the same for the same seed."""
    detector, rng = DETECTORS[algorithm], np.random.default_rng(seed)
    out = [dict(detector.defaults), detector.defaults | detector.bad_defaults]
    for _ in range(n):
        drawn = {}
        for name, space in detector.space.items():
            if isinstance(space, list):
                drawn[name] = space[int(rng.integers(len(space)))]
            else:
                lo, hi = space
                drawn[name] = int(rng.integers(lo, hi + 1)) if isinstance(lo, int) else float(rng.uniform(lo, hi))
        out.append(detector.defaults | drawn)
    return out


def run_trials(series: DataFrame, jobs: DataFrame, by: list[str], metric: str = "RangePrAUC") -> DataFrame:
    """(by.., algorithm, params_json, quality, duration): each distinct setting is run once per series; quality is a
    metric of ``METRICS`` on the scores; scores that aren't finite, and series without both labels, give 0."""
    import json
    import time

    measure, continuous = METRICS[metric]
    if not continuous:
        raise ValueError(f"{metric} takes predictions, not scores")
    registered = dict(DETECTORS)  # with what was registered here, which workers don't know of
    spread = series.select(*by, "t", "value", "is_anomaly").join(jobs.select(*by, "algorithm", "params_json").distinct(), by)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        algorithm, params = key[-2], json.loads(key[-1])
        detector = registered[algorithm]
        begin = time.monotonic()
        score, y = execute(rows["value"].to_numpy(float), detector, params), rows["is_anomaly"].to_numpy(bool)
        quality = float(np.nan_to_num(measure(y, score))) if y.any() and not y.all() and np.isfinite(score).all() else 0.0
        return pd.DataFrame([{**dict(zip(by, key, strict=False)), "algorithm": algorithm, "params_json": key[-1], "quality": quality, "duration": time.monotonic() - begin}])

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*by).schema)
    return spread.groupBy(*by, "algorithm", "params_json").applyInPandas(run, f"{keys}, algorithm string, params_json string, quality double, duration double")


def should_stop(trials: DataFrame, threshold: float = 0.95, n: int = 10) -> bool:
    """Whether at least ``n`` trials reach the threshold."""
    return trials.where(F.col("quality") >= threshold).limit(n).count() >= n
