"""Report queries over the store's stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsquorum.plans import reports as r
from tsquorum.plans import views as v
from tsquorum.plans.registry import query

ST = f"WITH {v.STORE_SQL}"
METHOD = "ranking_method || '-' || normalization_method || '-' || aggregation_method"
TYPE = "CASE WHEN name LIKE 'select%' THEN 'selective ensemble' WHEN name = 'best-algo' THEN 'oracle' ELSE 'baseline' END"


@query(f"{ST} SELECT DISTINCT hexhash, name, collection FROM dataset WHERE hexhash IN (SELECT dataset_id FROM execution WHERE version IN ('F') AND ranking_method IN ('1-URGENT', '2-HIGH'))")
def q1_list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return r.list_datasets(s["execution"], s["dataset"], versions=["F"], ranking_methods=["1-URGENT", "2-HIGH"], config_ids=[])


@query(f"{ST} SELECT collection, count(*) AS n FROM dataset WHERE paper GROUP BY 1")
def q2_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.collections(v.store(spark, sf_dir)["dataset"])


@query(f"{ST} SELECT DISTINCT version, config_id, experiment_id FROM execution")
def q3_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.store(spark, sf_dir)["execution"].select("version", "config_id", "experiment_id").distinct()


@query(f"WITH {v.SERIES_SQL} SELECT series_id, t, value, is_anomaly FROM ts ORDER BY series_id, t")
def q4_load_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.series(spark, sf_dir).orderBy("series_id", "t").select("series_id", "t", "value", "is_anomaly")


@query(f"""WITH {v.SERIES_SQL},\n{v.SCORES_SQL}, st AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WINDOW w AS (PARTITION BY series_id, instance))
SELECT series_id, t, round(avg((score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 6) AS score FROM st GROUP BY 1, 2""")
def q9_aggregated_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsquorum.operators import scores

    return scores.combined(v.user_scores(spark, sf_dir), ["series_id"], "minmax", "mean").withColumn("score", F.round("score", 6))


@query(f"{ST} SELECT {METHOD} AS method, 'ensemble' AS type FROM execution UNION SELECT name, {TYPE} FROM baseline")
def q5_available_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return r.available_methods(s["execution"], s["baseline"])


ALL = f"""al AS (SELECT dataset_id, {METHOD} AS method, 'ensemble' AS type, range_pr_auc, runtime FROM execution UNION ALL SELECT dataset_id, name, {TYPE}, range_pr_auc, runtime FROM baseline),
results AS (SELECT al.*, d.name AS dataset, d.collection FROM al JOIN dataset d ON d.hexhash = al.dataset_id)"""


@query(f"{ST},\n{ALL} SELECT * FROM results")
def q6_all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return r.all_results(s["execution"], s["baseline"], s["dataset"])


@query(f"{ST},\n{ALL} SELECT * FROM results WHERE method NOT LIKE '%custom' AND method NOT LIKE '%gaussian%' AND method NOT LIKE '5%'")
def f10_method_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.without_methods(q6_all_results(spark, sf_dir), "custom", "gaussian", "5")


@query(f"{ST},\n{ALL} SELECT dataset_id, method, round(max(range_pr_auc), 6) AS quality FROM results WHERE type = 'oracle' GROUP BY 1, 2")
def q7_method_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q6_all_results(spark, sf_dir).where("type = 'oracle'").groupBy("dataset_id", "method").agg(F.round(F.max("range_pr_auc"), 6).alias("quality"))


@query(f"{ST} SELECT e.id AS execution_id, e.dataset_id, s.rank, s.algorithm, s.range_pr_auc AS quality FROM execution e JOIN scoring s ON s.ranking_id = e.algorithm_ranking_id WHERE e.normalization_method = 'minmax'")
def q8_ranking_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return r.ranking_results(r.filtered(s["execution"], normalization_methods=["minmax"]), s["scoring"])


@query(f"{ST} SELECT b.id AS baseline_id, b.name, coalesce(s.rank, 1) AS rank, coalesce(s.id, b.algorithm_scoring_id) AS scoring_id FROM baseline b LEFT JOIN scoring s ON s.ranking_id = b.algorithm_ranking_id")
def j4_baseline_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return r.baseline_rankings(s["baseline"], s["scoring"])


@query(f"{ST} SELECT d.hexhash, d.name, b.name AS baseline, b.range_pr_auc FROM dataset d LEFT JOIN baseline b ON b.dataset_id = d.hexhash")
def j2_dataset_left_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    b = s["baseline"].select(F.col("dataset_id").alias("hexhash"), F.col("name").alias("baseline"), "range_pr_auc")
    return s["dataset"].select("hexhash", "name").join(b, "hexhash", "left")


@query(f"{ST} SELECT trace_name, experiment_id, e.config_id, sum(duration_ns)::BIGINT AS duration_ns FROM trace t JOIN (SELECT DISTINCT experiment_id AS x, config_id FROM execution) e ON e.x = t.experiment_id WHERE trace_type = 'END' AND trace_name IN ('click', 'error') GROUP BY 1, 2, 3")
def q10_runtime_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return r.runtime_traces(s["trace"], s["execution"], ["click", "error"]).groupBy("trace_name", "experiment_id", "config_id").agg(F.sum("duration_ns").alias("duration_ns"))


@query(f"{ST} SELECT {METHOD} AS method, round(avg(runtime), 4) AS mean_runtime, count(DISTINCT dataset_id) AS datasets FROM execution GROUP BY 1 UNION SELECT name, round(avg(runtime), 4), count(DISTINCT dataset_id) FROM baseline GROUP BY 1")
def q11_mean_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return r.mean_runtimes(s["execution"], s["baseline"])


@query(f"{ST} SELECT e.id, d.name, e.runtime FROM execution e JOIN dataset d ON d.hexhash = e.dataset_id WHERE d.paper AND e.aggregation_method = 'mean'")
def q12_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    d = r.chosen(s["dataset"], paper=True).select(F.col("hexhash").alias("dataset_id"), "name")
    return r.filtered(s["execution"], aggregation_methods=["mean"]).join(d, "dataset_id").select("id", "name", "runtime")


@query("""SELECT user_id, (props ->> '$.k')::INTEGER % 10 AS seed, CASE WHEN (props ->> '$.k')::INTEGER % 2 = 0 THEN 0 ELSE (props ->> '$.k')::INTEGER END AS max_trials, round(stddev_samp(value), 4) AS variance
FROM events WHERE event_type LIKE '%c%' GROUP BY 1, 2, 3""")
def q13_optimization_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = v.table(spark, sf_dir, "events").where(F.col("event_type").like("%c%"))
    return e.groupBy("user_id", (k % 10).alias("seed"), F.when(k % 2 == 0, 0).otherwise(k).alias("max_trials")).agg(F.round(F.stddev_samp("value"), 4).alias("variance"))


@query(f"""{ST}, a AS (SELECT dataset_id, normalization_method, aggregation_method, max(range_pr_auc) AS x FROM execution WHERE config_id >= 2 GROUP BY 1, 2, 3),
b AS (SELECT dataset_id, normalization_method, aggregation_method, max(range_pr_auc) AS y FROM execution WHERE config_id < 2 GROUP BY 1, 2, 3)
SELECT dataset_id, normalization_method, aggregation_method, round(x - y, 6) AS improvement FROM a JOIN b USING (dataset_id, normalization_method, aggregation_method)""")
def q14_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.improvements(v.store(spark, sf_dir)["execution"], F.col("config_id") >= 2, F.col("config_id") < 2)


@query(f"{ST} SELECT e.id AS execution_id, e.dataset_id, s.rank, s.algorithm, s.range_pr_auc AS quality FROM execution e JOIN scoring s ON s.ranking_id = e.algorithm_ranking_id AND s.rank = 0")
def q15_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return r.top1(s["execution"], s["scoring"])


@query(f"WITH {v.SERIES_SQL} SELECT series_id % 5 AS period, count(*) FILTER (WHERE is_anomaly AND t % 3 = 0) AS hit, count(*) FILTER (WHERE t % 3 = 0) AS masked FROM ts GROUP BY 1")
def q16_cleaning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.series(spark, sf_dir)
    return p.groupBy((F.col("series_id") % 5).alias("period")).agg(F.count_if(F.col("is_anomaly") & (F.col("t") % 3 == 0)).alias("hit"), F.count_if(F.col("t") % 3 == 0).alias("masked"))


@query(f"""{ST}, x AS (SELECT ranking_method, dataset_id, range_pr_auc, count(*) OVER (PARTITION BY dataset_id) AS per_dataset FROM execution)
SELECT ranking_method, round(avg(range_pr_auc), 6) AS mean, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY range_pr_auc), 6) AS median, max(per_dataset) AS most FROM x GROUP BY 1""")
def q17_mean_and_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.store(spark, sf_dir)["execution"].withColumn("per_dataset", F.count(F.lit(1)).over(Window.partitionBy("dataset_id")))
    return e.groupBy("ranking_method").agg(F.round(F.avg("range_pr_auc"), 6).alias("mean"), F.round(F.percentile("range_pr_auc", F.lit(0.5)), 6).alias("median"), F.max("per_dataset").alias("most"))


@query(f"""{ST}, a AS (SELECT trace_name, round(avg(duration_ns), 3) AS mean, round(stddev_samp(duration_ns), 3) AS dev FROM trace GROUP BY 1), b AS (SELECT trace_name, min(position) AS first FROM trace WHERE trace_type = 'START' GROUP BY 1)
SELECT trace_name, mean, dev, first FROM a JOIN b USING (trace_name) ORDER BY first""")
def q18_stage_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.store(spark, sf_dir)["trace"]
    a = t.groupBy("trace_name").agg(F.round(F.avg("duration_ns"), 3).alias("mean"), F.round(F.stddev_samp("duration_ns"), 3).alias("dev"))
    return a.join(t.where("trace_type = 'START'").groupBy("trace_name").agg(F.min("position").alias("first")), "trace_name").orderBy("first")


@query(f"""{ST}, w AS (SELECT *, max(window_size) OVER (PARTITION BY experiment_id, algorithm) AS most, count(*) OVER (PARTITION BY experiment_id, algorithm) AS n FROM scoring)
SELECT experiment_id, algorithm, n, trunc((count(*) FILTER (WHERE window_size >= most - 50)) * 100.0 / n, 2)::DOUBLE AS share FROM w GROUP BY 1, 2, 3""")
def q19_share_at_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("experiment_id", "algorithm")
    s = v.store(spark, sf_dir)["scoring"].withColumn("most", F.max("window_size").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    share = F.floor(F.count_if(F.col("window_size") >= F.col("most") - 50) * 10000 / F.col("n")) / 100
    return s.groupBy("experiment_id", "algorithm", "n").agg(share.alias("share"))


@query(f"{ST} SELECT dataset_id, count(*) AS missing FROM baseline WHERE algorithm_ranking_id IS NULL OR algorithm_scoring_id IS NULL GROUP BY 1")
def q20_missing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.store(spark, sf_dir)["baseline"]
    return b.where(F.col("algorithm_ranking_id").isNull() | F.col("algorithm_scoring_id").isNull()).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("missing"))


@query(f"""{ST},\n{ALL}, b AS (SELECT *, row_number() OVER (PARTITION BY collection, dataset ORDER BY range_pr_auc DESC, method, runtime) AS n FROM results)
SELECT collection, dataset, method, range_pr_auc FROM b WHERE n = 1 AND range_pr_auc > 0.6""")
def q21_oracle_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = r.best_per_group(q6_all_results(spark, sf_dir), ["collection", "dataset"], "range_pr_auc", ["method", "runtime"])
    return best.where("range_pr_auc > 0.6").select("collection", "dataset", "method", "range_pr_auc")


@query(f"{ST} SELECT version, CASE WHEN config_id = 1 THEN 9 ELSE config_id END AS config_id, count(*) AS n FROM execution WHERE experiment_id <> 3 GROUP BY 1, 2")
def q22_rewritten_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = r.without_experiment(v.store(spark, sf_dir), 3)["execution"]
    return e.withColumn("config_id", F.when(F.col("config_id") == 1, 9).otherwise(F.col("config_id"))).groupBy("version", "config_id").agg(F.count(F.lit(1)).alias("n"))


# ---- joins, aggregates, sorts, sets


@query(f"{ST} SELECT e.id, d.name, d.collection, e.config_id FROM execution e, dataset d WHERE e.dataset_id = d.hexhash AND d.revision")
def j1_execution_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    d = r.chosen(s["dataset"], revision=True).select(F.col("hexhash").alias("dataset_id"), "name", "collection")
    return s["execution"].join(d, "dataset_id").select("id", "name", "collection", "config_id")


@query(f"""{ST}, known AS (SELECT algorithm, window_size FROM scoring WHERE experiment_id < 5)
SELECT id, algorithm, window_size FROM scoring s WHERE experiment_id >= 5 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.algorithm = s.algorithm AND k.window_size = s.window_size)""")
def j10_exact_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)["scoring"]
    return r.exact_missing(s.where("experiment_id >= 5").select("id", "algorithm", "window_size"), s.where("experiment_id < 5"), ["algorithm", "window_size"])


@query(f"""{ST}, known AS (SELECT algorithm, window_size FROM scoring WHERE experiment_id < 1)
SELECT id, algorithm, window_size FROM scoring WHERE experiment_id >= 5 AND NOT (algorithm IN (SELECT algorithm FROM known) AND window_size IN (SELECT window_size FROM known))""")
def j11_loose_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)["scoring"]
    return r.loose_missing(s.where("experiment_id >= 5").select("id", "algorithm", "window_size"), s.where("experiment_id < 1"), ["algorithm", "window_size"])


@query(f"""{ST} SELECT e.id AS execution_id, d.name, d.collection, s.rank, s.algorithm, e.config_id FROM execution e, dataset d, scoring s
WHERE e.dataset_id = d.hexhash AND s.ranking_id = e.algorithm_ranking_id AND d.paper AND s.rank = 0""")
def j3_five_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    d = r.chosen(s["dataset"], paper=True).select(F.col("hexhash").alias("dataset_id"), "name", "collection")
    first = r.top1(s["execution"], s["scoring"]).join(d, "dataset_id")
    configs = s["execution"].select(F.col("id").alias("execution_id"), "config_id")
    return first.join(configs, "execution_id").select("execution_id", "name", "collection", "rank", "algorithm", "config_id")


@query(f"""{ST}, a AS (SELECT algorithm, window_size, avg(range_pr_auc) AS q FROM scoring WHERE experiment_id >= 5 GROUP BY 1, 2), b AS (SELECT algorithm, window_size, avg(range_pr_auc) AS q FROM scoring WHERE experiment_id < 5 GROUP BY 1, 2)
SELECT a.algorithm, a.window_size, round(a.q - b.q, 6) AS difference FROM a JOIN b ON a.algorithm = b.algorithm AND a.window_size = b.window_size""")
def j5_self_join_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, keys = v.store(spark, sf_dir)["scoring"], ["algorithm", "window_size"]
    a = s.where("experiment_id >= 5").groupBy(*keys).agg(F.avg("range_pr_auc").alias("_a"))
    b = s.where("experiment_id < 5").groupBy(*keys).agg(F.avg("range_pr_auc").alias("_b"))
    return a.join(b, keys).select(*keys, F.round(F.col("_a") - F.col("_b"), 6).alias("difference"))


@query(f"""{ST}, c AS (SELECT algorithm, window_size, count(*) AS no_datasets FROM scoring WHERE experiment_id < 5 GROUP BY 1, 2)
SELECT s.id, s.algorithm, s.window_size, c.no_datasets FROM scoring s LEFT JOIN c ON c.algorithm = s.algorithm AND c.window_size = s.window_size""")
def j7_left_on_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, keys = v.store(spark, sf_dir)["scoring"], ["algorithm", "window_size"]
    c = s.where("experiment_id < 5").groupBy(*keys).agg(F.count(F.lit(1)).alias("no_datasets"))
    return s.select("id", *keys).join(c, keys, "left")


@query(f"""{ST}, q AS (SELECT algorithm, avg(range_pr_auc) AS q FROM scoring GROUP BY 1), t AS (SELECT algorithm, avg(runtime) AS t FROM scoring GROUP BY 1) SELECT algorithm, round(q, 6) AS quality, round(t, 6) AS runtime FROM q JOIN t USING (algorithm)""")
def j8_proxy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)["scoring"]
    q = s.groupBy("algorithm").agg(F.round(F.avg("range_pr_auc"), 6).alias("quality"))
    return q.join(s.groupBy("algorithm").agg(F.round(F.avg("runtime"), 6).alias("runtime")), "algorithm")


@query(f"""{ST}, o AS (SELECT *, row_number() OVER (PARTITION BY algorithm, window_size ORDER BY range_pr_auc DESC, runtime, id) AS n FROM scoring)
SELECT s.id, p.id AS representative FROM scoring s LEFT JOIN o p ON p.algorithm = s.algorithm AND p.window_size = s.window_size AND p.n = 1""")
def j9_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, keys = v.store(spark, sf_dir)["scoring"], ["algorithm", "window_size"]
    best = r.best_per_group(s, keys, "range_pr_auc", ["runtime", "id"]).select(*keys, F.col("id").alias("representative"))
    return s.select("id", *keys).join(best, keys, "left").select("id", "representative")


@query(f"""{ST} SELECT d.hexhash, count(*) AS n, round(max(e.range_pr_auc), 6) AS best FROM execution e JOIN (SELECT hexhash, collection, name FROM dataset) d ON e.dataset_id = d.hexhash GROUP BY 1""")
def j19_external_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsquorum.sources.store import external_baselines

    s = v.store(spark, sf_dir)
    names = s["dataset"].select(F.col("hexhash").alias("dataset_id"), "collection", F.col("name").alias("dataset"))
    results = s["execution"].join(names, "dataset_id").select("collection", "dataset", F.col("ranking_method").alias("algorithm"), "range_pr_auc", "runtime")
    best = external_baselines(results, s["dataset"], "range_pr_auc")["best-algo"].select("hexhash", F.round("range_pr_auc", 6).alias("best"))
    n = s["execution"].groupBy(F.col("dataset_id").alias("hexhash")).agg(F.count(F.lit(1)).alias("n"))
    return best.join(n, "hexhash").select("hexhash", "n", "best")


@query(f"{ST} SELECT hexhash FROM dataset WHERE hexhash NOT IN (SELECT dataset_id FROM baseline)")
def j12_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return s["dataset"].select("hexhash").join(s["baseline"].select(F.col("dataset_id").alias("hexhash")), "hexhash", "left_anti")


@query(f"{ST} SELECT e.id FROM execution e LEFT JOIN baseline b ON b.dataset_id = e.dataset_id WHERE b.id IS NULL")
def j13_left_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return s["execution"].join(s["baseline"].select("dataset_id").distinct(), "dataset_id", "left_anti").select("id")


@query(f"{ST} SELECT id FROM execution WHERE dataset_id IN (SELECT dataset_id FROM baseline WHERE range_pr_auc > 0.5)")
def j14_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return s["execution"].join(s["baseline"].where("range_pr_auc > 0.5").select("dataset_id"), "dataset_id", "left_semi").select("id")


@query(f"{ST} SELECT hexhash, (SELECT e.id FROM execution e WHERE e.dataset_id = d.hexhash ORDER BY e.range_pr_auc DESC, e.id LIMIT 1) AS best FROM dataset d")
def j15_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    best = s["execution"].groupBy(F.col("dataset_id").alias("hexhash")).agg(F.max_by("id", F.struct("range_pr_auc", -F.col("id"))).alias("best"))
    return s["dataset"].select("hexhash").join(best, "hexhash", "left")


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def j16_unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = v.table(spark, sf_dir, "nation").select("n_nationkey")
    return n.select(F.col("n_nationkey").alias("i")).join(n.select(F.col("n_nationkey").alias("j")), F.col("i") < F.col("j"))


@query(f"{ST} SELECT r, n, a FROM (SELECT DISTINCT ranking_method AS r FROM execution), (SELECT DISTINCT normalization_method AS n FROM execution), (SELECT DISTINCT aggregation_method AS a FROM execution)")
def j21_all_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.store(spark, sf_dir)["execution"]
    parts = [e.select(F.col(c).alias(n)).distinct() for c, n in zip(r.METHOD_PARTS, "rna", strict=True)]  # a handful of names each
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


@query(f"{ST} SELECT DISTINCT experiment_id, trace_name FROM trace WHERE experiment_id IN (SELECT experiment_id FROM execution WHERE version = 'O')")
def j6_trace_join_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return s["trace"].select("experiment_id", "trace_name").distinct().join(s["execution"].where("version = 'O'").select("experiment_id").distinct(), "experiment_id")


@query(f"{ST} SELECT d.hexhash, b.name AS baseline, e.id FROM dataset d LEFT JOIN baseline b ON b.dataset_id = d.hexhash JOIN execution e ON e.dataset_id = d.hexhash WHERE e.config_id = 0")
def j22_left_then_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    e = s["execution"].where("config_id = 0").select(F.col("dataset_id").alias("hexhash"), "id")
    b = s["baseline"].select(F.col("dataset_id").alias("hexhash"), F.col("name").alias("baseline"))
    return s["dataset"].select("hexhash").join(b, "hexhash", "left").join(e, "hexhash")


@query(f"""{ST},\n{ALL}, b AS (SELECT *, row_number() OVER (PARTITION BY collection, dataset_id ORDER BY range_pr_auc DESC, method, runtime) AS n FROM results) SELECT collection, dataset_id, method, range_pr_auc FROM b WHERE n = 1""")
def a5_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.best_per_group(q6_all_results(spark, sf_dir), ["collection", "dataset_id"], "range_pr_auc", ["method", "runtime"]).select("collection", "dataset_id", "method", "range_pr_auc")


@query(f"{ST},\n{ALL} SELECT collection, dataset_id, method, type, round(avg(range_pr_auc), 6) AS mean_quality FROM results GROUP BY 1, 2, 3, 4")
def a6_mean_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q6_all_results(spark, sf_dir).groupBy("collection", "dataset_id", "method", "type").agg(F.round(F.avg("range_pr_auc"), 6).alias("mean_quality"))


@query(f"{ST} SELECT algorithm, window_size, min(id) AS params_from, count(DISTINCT ranking_id) AS no_datasets FROM scoring GROUP BY 1, 2")
def a7_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.store(spark, sf_dir)["scoring"].groupBy("algorithm", "window_size").agg(F.min("id").alias("params_from"), F.countDistinct("ranking_id").alias("no_datasets"))


@query(f"""{ST}, b AS (SELECT *, row_number() OVER (PARTITION BY ranking_id ORDER BY range_pr_auc DESC, algorithm, id) AS n FROM scoring) SELECT ranking_id, algorithm, range_pr_auc FROM b WHERE n = 1""")
def a8_best_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.best_per_group(v.store(spark, sf_dir)["scoring"], ["ranking_id"], "range_pr_auc", ["algorithm", "id"]).select("ranking_id", "algorithm", "range_pr_auc")


@query(f"""{ST}, s AS (SELECT algorithm, experiment_id, stddev_samp(range_pr_auc) AS d FROM scoring GROUP BY 1, 2) SELECT algorithm, round(max(d), 6) AS most FROM s GROUP BY 1""")
def a9_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)["scoring"].groupBy("algorithm", "experiment_id").agg(F.stddev_samp("range_pr_auc").alias("d"))
    return s.groupBy("algorithm").agg(F.round(F.max("d"), 6).alias("most"))


@query(f"{ST} SELECT algorithm, round(avg(range_pr_auc), 6) AS mean_train_quality, round(avg(runtime), 6) AS mean_train_runtime FROM scoring GROUP BY 1")
def a10_proxy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.store(spark, sf_dir)["scoring"].groupBy("algorithm").agg(F.round(F.avg("range_pr_auc"), 6).alias("mean_train_quality"), F.round(F.avg("runtime"), 6).alias("mean_train_runtime"))


@query(f"""{ST}, o AS (SELECT *, row_number() OVER (PARTITION BY algorithm, window_size ORDER BY range_pr_auc DESC, runtime, id) AS n FROM scoring) SELECT algorithm, window_size, id FROM o WHERE n = 1""")
def a11_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.best_per_group(v.store(spark, sf_dir)["scoring"], ["algorithm", "window_size"], "range_pr_auc", ["runtime", "id"]).select("algorithm", "window_size", "id")


@query(f"WITH {v.SERIES_SQL}, n AS (SELECT series_id, count(*) AS length FROM ts GROUP BY 1) SELECT length, count(*) AS series FROM n GROUP BY 1")
def a13_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.series(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("series"))


@query(f"WITH {v.SERIES_SQL} SELECT series_id % 5 AS period, t, bool_or(is_anomaly) AS mask FROM ts GROUP BY 1, 2")
def a14_or_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.series(spark, sf_dir).groupBy((F.col("series_id") % 5).alias("period"), "t").agg(F.bool_or("is_anomaly").alias("mask"))


@query(f"{ST} SELECT version, count(*) AS n, count(DISTINCT dataset_id) AS datasets, round(avg(runtime), 4) AS mean, round(stddev_samp(runtime), 4) AS dev, round(sum(runtime), 2) AS total, min(runtime) AS lo, max(runtime) AS hi FROM execution GROUP BY 1")
def a16_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.store(spark, sf_dir)["execution"].groupBy("version").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("dataset_id").alias("datasets"), F.round(F.avg("runtime"), 4).alias("mean"), F.round(F.stddev_samp("runtime"), 4).alias("dev"),
        F.round(F.sum("runtime"), 2).alias("total"), F.min("runtime").alias("lo"), F.max("runtime").alias("hi"))


@query(f"{ST} SELECT dataset_id, round(avg(range_pr_auc) FILTER (WHERE aggregation_method = 'max'), 6) AS q_max, round(avg(range_pr_auc) FILTER (WHERE aggregation_method = 'mean'), 6) AS q_mean, round(avg(range_pr_auc) FILTER (WHERE aggregation_method = 'custom'), 6) AS q_custom FROM execution GROUP BY 1")
def a17_filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.store(spark, sf_dir)["execution"].groupBy("dataset_id").pivot("aggregation_method", ["max", "mean", "custom"]).agg(F.round(F.avg("range_pr_auc"), 6))
    return p.select("dataset_id", *[F.col(m).alias(f"q_{m}") for m in ("max", "mean", "custom")])


@query(f"{ST} SELECT dataset_id, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY runtime), 7) AS median FROM execution GROUP BY 1")
def a18_ordered_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.store(spark, sf_dir)["execution"].groupBy("dataset_id").agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY runtime)"), 7).alias("median"))


@query(f"{ST} SELECT DISTINCT name FROM baseline")
def a20_distinct_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.store(spark, sf_dir)["baseline"].select("name").distinct()


@query(f"""{ST},\n{ALL} SELECT collection, round(avg(range_pr_auc) FILTER (WHERE type = 'ensemble'), 6) AS ensemble, round(avg(range_pr_auc) FILTER (WHERE type = 'oracle'), 6) AS oracle FROM results GROUP BY 1""")
def a22_quality_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q6_all_results(spark, sf_dir).groupBy("collection").pivot("type", ["ensemble", "oracle"]).agg(F.round(F.avg("range_pr_auc"), 6))


@query(f"{ST} SELECT run, CASE WHEN trace_name IN ('click', 'view') THEN 'browse' ELSE trace_name END AS trace_group, sum(duration_ns)::BIGINT AS duration_ns, min(position) AS position FROM trace GROUP BY 1, 2")
def a23_grouped_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.grouped_traces(v.store(spark, sf_dir)["trace"], {"browse": ["click", "view"]}, ["run"])


@query(f"{ST} SELECT position, round(duration_ns * 100.0 / sum(duration_ns) OVER (PARTITION BY run), 5) AS percent FROM trace")
def a24_relative_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.relative_runtime(v.store(spark, sf_dir)["trace"], ["run"]).select("position", F.round("percent", 5).alias("percent"))


@query(f"{ST} SELECT trace_name, experiment_id, round(median(duration_ns), 3) AS median, round(avg(duration_ns), 3) AS mean FROM trace GROUP BY 1, 2")
def a25_trace_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.store(spark, sf_dir)["trace"].groupBy("trace_name", "experiment_id").agg(F.round(F.median("duration_ns"), 3).alias("median"), F.round(F.avg("duration_ns"), 3).alias("mean"))


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1:' || c_custkey), c_custkey) AS n FROM customer) WHERE n <= 10")
def a26_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.stratified(v.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 10)


@query(f"{ST} SELECT hexhash, name, b.range_pr_auc FROM dataset d LEFT JOIN (SELECT dataset_id, max(range_pr_auc) AS range_pr_auc FROM baseline GROUP BY 1) b ON b.dataset_id = d.hexhash ORDER BY range_pr_auc DESC NULLS LAST, hexhash LIMIT 50")
def k8_nulls_last_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    b = s["baseline"].groupBy(F.col("dataset_id").alias("hexhash")).agg(F.max("range_pr_auc").alias("range_pr_auc"))
    return s["dataset"].select("hexhash", "name").join(b, "hexhash", "left").orderBy(F.col("range_pr_auc").desc_nulls_last(), "hexhash").limit(50)


@query("SELECT n_name, length(n_name) AS len FROM nation ORDER BY length(n_name) DESC, n_name LIMIT 5")
def k9_order_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = v.table(spark, sf_dir, "nation")
    return n.select("n_name", F.length("n_name").cast("long").alias("len")).orderBy(F.length("n_name").desc(), "n_name").limit(5)


@query(f"{ST} SELECT ranking_method AS m FROM execution UNION SELECT name FROM baseline")
def u1_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return s["execution"].select(F.col("ranking_method").alias("m")).union(s["baseline"].select("name")).distinct()


@query(f"{ST} SELECT 'execution' AS t, count(*) AS n FROM execution UNION SELECT 'baseline', count(*) FROM baseline")
def u2_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return s["execution"].agg(F.lit("execution").alias("t"), F.count(F.lit(1)).alias("n")).union(s["baseline"].agg(F.lit("baseline"), F.count(F.lit(1)))).distinct()


@query(f"{ST} SELECT id, dataset_id FROM execution WHERE config_id = 0 UNION ALL SELECT id, dataset_id FROM baseline")
def u3_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.store(spark, sf_dir)
    return s["execution"].where("config_id = 0").select("id", "dataset_id").unionByName(s["baseline"].select("id", "dataset_id"))


@query(f"{ST} SELECT DISTINCT experiment_id FROM execution WHERE version = 'O' EXCEPT SELECT experiment_id FROM execution WHERE version = 'P'")
def u7_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.store(spark, sf_dir)["execution"]
    return e.where("version = 'O'").select("experiment_id").subtract(e.where("version = 'P'").select("experiment_id"))


@query(f"{ST} SELECT DISTINCT version, dataset_id FROM execution")
def u8_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.store(spark, sf_dir)["execution"].select("version", "dataset_id").distinct()


@query(f"WITH {v.SERIES_SQL} SELECT series_id, count(*) AS n, round(avg(is_anomaly::INT), 6) AS contamination FROM ts GROUP BY 1 HAVING sum(is_anomaly::INT) > 0 AND avg(is_anomaly::INT) <= 0.2")
def f11_admissible_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = v.series(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_anomaly").cast("int")).alias("c"))
    return per.where("c > 0 and c <= 0.2").select("series_id", "n", F.round("c", 6).alias("contamination"))


@query("SELECT event_id, coalesce(nullif(value, 'NaN'::DOUBLE), 0) AS value FROM events WHERE event_type LIKE '%c%' AND value BETWEEN 10 AND 100 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND props IS NOT NULL")
def f16_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events")
    debtors = v.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    kept = e.where(F.col("event_type").like("%c%") & F.col("value").between(10, 100) & F.col("props").isNotNull()).join(debtors, "user_id", "left_anti")
    return kept.select("event_id", F.coalesce(F.nanvl("value", F.lit(None).cast("double")), F.lit(0.0)).alias("value"))


@query("""SELECT event_id, split_part(event_type, 'i', 1) AS head, upper(event_type) || '-' || user_id AS name, replace(event_type, 'c', 'k') AS k, (props ->> '$.k')::INTEGER AS seed, md5(event_type || ':' || user_id) AS id,
  CASE WHEN value >= 1000 THEN 'high' WHEN value >= 100 THEN 'mid' ELSE 'low' END AS band FROM events""")
def x_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = v.table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    return e.select(
        "event_id", F.split_part("event_type", F.lit("i"), F.lit(1)).alias("head"), F.concat(F.upper("event_type"), F.lit("-"), u).alias("name"), F.replace("event_type", F.lit("c"), F.lit("k")).alias("k"),
        F.get_json_object("props", "$.k").cast("int").alias("seed"), F.md5(F.concat_ws(":", "event_type", u)).alias("id"), F.when(F.col("value") >= 1000, "high").when(F.col("value") >= 100, "mid").otherwise("low").alias("band"))
