"""The whole run for many series at once: training data, search, execution on the targets, selection, combination.

Every stage takes and returns frames keyed by series_id; a stage's result is written to a folder and reused when it is
there already, so a run can be resumed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsquorum.operators import detectors, generation, injection, metrics, optimization, scores, selection, slices, studies
from tsquorum.plans.config import Config

S = ["series_id"]


def estimate_period(points: DataFrame, config: Config) -> DataFrame:
    """(series_id, n, period): by peaks; where that gives nothing usable, a tenth of the series."""
    n = points.groupBy(*S).agg(F.count(F.lit(1)).alias("n"))
    found = generation.peak_period(points, S, config.cleaning.reach).join(n, S)
    fault = generation.period_fault(F.col("period"), F.col("n"), config.data_gen.max_period, share=config.data_gen.period_share)
    usable = F.col("period").isNotNull() & fault.isNull()
    return found.select(*S, "n", F.when(usable, F.col("period")).otherwise(F.greatest(F.floor(F.col("n") / 20), F.lit(8))).cast("long").alias("period"))


def base_series(points: DataFrame, periods: DataFrame, config: Config) -> DataFrame:
    """Cleaned and length-limited base series, labels dropped, renumbered.

    With ``cleaning.by_labels`` the labelled anomalies are cut out instead of what the detectors vote for, to tell what
    imperfect cleaning costs; only then are labels looked at, and null ones count as normal.
    """
    if config.cleaning.by_labels:
        cuts = slices.mask_to_slices(points, S, "is_anomaly")
    else:
        jobs = _jobs(points.sparkSession, {a: detectors.DETECTORS[a].for_period(20) for a in ("subsequence_knn", "kmeans", "dwt_mlead") if a in config.general.algorithms})
        scored = detectors.run_detectors(points, jobs, S, seed=config.general.seed)
        votes = generation.cleaning_votes(scored, S, F.lit(20), config.cleaning.quantile)
        cuts = generation.voted_cuts(votes, S, 10, config.cleaning.votes)
    limit = generation.length_limit(F.col("period"), config.data_gen.least_length, config.data_gen.periods)
    clean = generation.cleaned(points, cuts, S, periods.select(*S, limit.alias("limit")))
    return clean.select(*S, "t", "value", F.lit(False).alias("is_anomaly"))


def training_series(base: DataFrame, periods: DataFrame, config: Config) -> DataFrame:
    """(series_id, dataset, base, anomaly_type, length, t, value, is_anomaly) with one injected anomaly each."""
    a = config.anomaly
    sizes = base.groupBy(*S).agg(F.count(F.lit(1)).alias("n")).join(periods.select(*S, "period"), S)
    plan = injection.injection_plan(sizes, S, list(a.kinds), injection.admissible_lengths(F.col("period"), F.col("n"), a.lengths, a.factors, a.fraction))
    made = injection.inject_all(base, plan, S, config.general.seed)
    return made.select(*S, F.concat_ws("-", F.col("series_id").cast("string"), "anomaly_type", F.col("length").cast("string")).alias("dataset"), F.col("series_id").alias("base"), "anomaly_type", "length", "t", "value", "is_anomaly")


def search(train: DataFrame, config: Config, folder: str | None = None) -> DataFrame:
    """(series_id, algorithm, params_json, no_datasets, mean_train_quality, mean_train_runtime, position): candidates per series.

    A study per algorithm and training series; each round runs some trials of every open one, asked for from those before, then
    studies stop and the worst algorithm of each training series is pruned. Trials are kept in ``folder``, from which a
    search that broke off resumes. Settings best on some training series, and the defaults, become candidates.
    """
    o, spark = config.optimization, train.sparkSession
    keys = [*S, "dataset"]
    names = train.select(*keys).distinct()
    wanted = names.withColumn("algorithm", F.explode(F.array(*[F.lit(a) for a in config.general.algorithms])))
    log = studies.TrialLog(spark, folder or studies.scratch(spark, "trials"))
    trials = studies.run_studies(train, wanted, keys, log, o.rounds, max(2, -(-o.max_trials // o.rounds)), seed=config.general.seed, max_trials=o.max_trials, quality=o.quality, enough=o.enough, startup=min(studies.STARTUP, max(2, o.max_trials // 4)))
    order = Window.partitionBy(*keys).orderBy(F.col("quality").desc(), "algorithm", "params_json")
    won = trials.withColumn("_n", F.row_number().over(order)).where("_n = 1").groupBy(*S, "algorithm", "params_json").agg(F.countDistinct("dataset").alias("no_datasets"))
    defaults = spark.createDataFrame([(a, json.dumps(detectors.DETECTORS[a].defaults, sort_keys=True)) for a in config.general.algorithms], "algorithm string, params_json string")
    every = won.unionByName(names.select(*S).distinct().crossJoin(F.broadcast(defaults)).withColumn("no_datasets", F.lit(0).cast("long")))
    proxy = trials.groupBy(*S, "algorithm", "params_json").agg(F.avg("quality").alias("mean_train_quality"), F.avg("duration").alias("mean_train_runtime"))
    merged = every.groupBy(*S, "algorithm", "params_json").agg(F.max("no_datasets").alias("no_datasets"))
    return optimization.final_order(merged.join(proxy, [*S, "algorithm", "params_json"], "left"), S)


def _jobs(spark: SparkSession, settings: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([(a, a, json.dumps(p)) for a, p in settings.items()], "instance string, algorithm string, params_json string")


def execute(points: DataFrame, candidates: DataFrame, config: Config) -> DataFrame:
    """(series_id, instance, t, score) of every candidate on its target series."""
    named = candidates.select(*S, F.concat_ws("-", "algorithm", F.md5("params_json")).alias("instance"), "algorithm", "params_json")
    spread, registered = points.select(*S, "t", "value").join(named, S), dict(detectors.DETECTORS)

    def run(key, rows):
        import pandas as pd

        rows = rows.sort_values("t")
        score = detectors.execute(rows["value"].to_numpy(float), registered[rows["algorithm"].iloc[0]], json.loads(rows["params_json"].iloc[0]), seed=config.general.seed)
        return pd.DataFrame({"series_id": key[0], "instance": key[1], "t": rows["t"].to_numpy(), "score": score})

    kind = points.schema["series_id"].dataType.simpleString()
    return spread.groupBy(*S, "instance").applyInPandas(run, f"series_id {kind}, instance string, t bigint, score double")


def combine(scored: DataFrame, candidates: DataFrame, config: Config, normalization: str = "minmax", combination: str = "custom") -> DataFrame:
    """(series_id, t, score) of the best instances of each series by training results, for all series at once."""
    named = candidates.withColumn("instance", F.concat_ws("-", "algorithm", F.md5("params_json")))
    good = scores.finite_instances(scored, S)
    here = named.join(good.select(*S, "instance").distinct(), [*S, "instance"], "left_semi")
    w = Window.partitionBy(*S)
    parts = []
    for c in ("no_datasets", "mean_train_quality"):
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        low, high = F.min(x).over(w), F.max(x).over(w)
        parts.append(F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0)))
    top = here.withColumn("_v", (parts[0] + parts[1]) / 2).withColumn("_n", F.row_number().over(w.orderBy(F.col("_v").desc(), "instance"))).where(F.col("_n") <= config.general.max_instances)
    return scores.combined(good.join(top.select(*S, "instance"), [*S, "instance"], "left_semi"), S, normalization, combination)


def stage(spark: SparkSession, folder: str | None, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's result, read if its folder is complete, else made and written."""
    if folder is None:
        return make()
    path = f"{folder.rstrip('/')}/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(points: DataFrame, config: Config | None = None, folder: str | None = None) -> DataFrame:
    """(series_id, t, score) for series (series_id, t, value, is_anomaly); labels are not used, unless the settings clean by them."""
    config, spark = config or Config(), points.sparkSession
    periods = stage(spark, folder, "periods", lambda: estimate_period(points, config))
    base = stage(spark, folder, "base", lambda: base_series(points, periods, config))
    train = stage(spark, folder, "train", lambda: training_series(base, periods, config))
    found = stage(spark, folder, "candidates", lambda: search(train, config, folder and f"{folder.rstrip('/')}/trials"))
    scored = stage(spark, folder, "scores", lambda: execute(points, found, config))
    s = config.scoring
    return stage(spark, folder, "combined", lambda: combine(scored, found, config, s.normalizations[0], s.combinations[0]))


def all_combinations(points: DataFrame, scored: DataFrame, candidates: DataFrame, config: Config) -> DataFrame:
    """(series_id, normalization, combination, roc_auc, pr_auc) against the labels of every combination."""
    out = None
    for n in config.scoring.normalizations:
        for c in config.scoring.combinations:
            labelled = combine(scored, candidates, config, n, c).join(points.select(*S, "t", "is_anomaly"), [*S, "t"])
            one = metrics.roc_auc(labelled, S).join(metrics.pr_auc(labelled, S), S, "left").withColumns({"normalization": F.lit(n), "combination": F.lit(c)})
            out = one if out is None else out.unionByName(one)
    return out


def oracle_choice(results: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """The best combination per series by a metric computed with labels: an oracle, not a method."""
    order = Window.partitionBy(*S).orderBy(F.col(metric).desc_nulls_last(), "normalization", "combination")
    return results.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def default_ensemble(points: DataFrame, algorithms: tuple[str, ...] = ("subsequence_knn", "kmeans", "dwt_mlead", "stomp"), width: int = 10) -> DataFrame:
    """Untrained detectors, min-max, excess combination: the run without its training part."""
    jobs = _jobs(points.sparkSession, {a: detectors.DETECTORS[a].for_period(width) for a in algorithms})
    return scores.combined(detectors.run_detectors(points, jobs, S), S)


def selected(candidates: DataFrame, scored: DataFrame, method: str, k: int) -> list[str]:
    return selection.select_instances(candidates, scored, S, method, k)
