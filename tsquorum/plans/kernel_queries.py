"""Queries over detectors, injection, generation, search and selective ensembles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsquorum.functions import scalar
from tsquorum.operators import detectors, echo, generation, grammar, injection, neighbours, optimization, selective, slices, studies
from tsquorum.plans import views as v
from tsquorum.plans.registry import query
from tsquorum.plans.series_queries import SC, S, TS

R6 = lambda c: F.round(c, 6)

# ---- detectors


def _detector(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Series of some 70 points need short windows; all else is as by default.
        params = {k: x for k, x in {"window_size": 10, "context_window_size": 5}.items() if k in detectors.DETECTORS[name].defaults}
        jobs = spark.createDataFrame([(name, name, json.dumps(params))], "instance string, algorithm string, params_json string")
        return detectors.run_detectors(v.series(spark, sf_dir), jobs, S).withColumn("score", R6(F.col("score")))

    return run


for _n, _name in enumerate(detectors.DETECTORS, 1):
    _f = _detector(_name)
    _f.__name__ = f"m{_n}_{_name}"
    query()(_f)


def _long_detector(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The detector on the hourly series, with a window of 100 where it has one and its defaults else."""
        params = {k: x for k, x in {"window_size": 100}.items() if k in detectors.DETECTORS[name].defaults}
        jobs = spark.createDataFrame([(name, name, json.dumps(params))], "instance string, algorithm string, params_json string")
        return detectors.run_detectors(v.hourly(spark, sf_dir), jobs, S).withColumn("score", R6(F.col("score")))

    return run


for _name in detectors.DETECTORS:
    _f = _long_detector(_name)
    _f.__name__ = f"mh_{_name}"
    query()(_f)


DAYS = f"""WITH {v.HOURLY_SQL}, w0 AS (SELECT series_id, t, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS w FROM ts), w AS (SELECT * FROM w0 WHERE len(w) = 24)"""


@query(f"""{DAYS}, d AS (SELECT a.series_id, a.t, b.t AS u, list_distance(a.w, b.w) AS d FROM w a JOIN w b ON a.series_id = b.series_id AND a.t <> b.t)
SELECT series_id, t AS id, round(avg(d), 5) AS mean, round(max(d), 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY series_id, t ORDER BY d, u) AS n FROM d) WHERE n <= 5 GROUP BY 1, 2""")
def m2_nearest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest windows of 24 hours each, the series cut into parts of 100 windows."""
    near = neighbours.nearest_windows(v.hourly(spark, sf_dir), S, F.lit(24), 5, length=100)
    mean = F.aggregate("distances", F.lit(0.0), lambda s, x: s + x) / F.size("distances")
    return near.select(*S, "id", F.round(mean, 5).alias("mean"), F.round(F.array_max("distances"), 5).alias("distance"))


@query(f"""{DAYS}, z AS (SELECT series_id, t, list_transform(w, lambda x: x - list_avg(w)) AS c, list_stddev_pop(w) < 1e-12 AS flat FROM w),
d AS (SELECT a.series_id, a.t, CASE WHEN a.flat AND b.flat THEN 0.0 WHEN a.flat OR b.flat THEN sqrt(24.0) ELSE sqrt(greatest(48 * (1 - least(1, greatest(-1, list_cosine_similarity(a.c, b.c)))), 0)) END AS d
  FROM z a JOIN z b ON a.series_id = b.series_id AND abs(a.t - b.t) > 6)
SELECT series_id, t AS id, round(min(d), 4) AS distance FROM d GROUP BY 1, 2""")
def m4_matrix_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix profile of days of hours, the series cut into parts of 100 windows."""
    near = neighbours.nearest_windows(v.hourly(spark, sf_dir), S, F.lit(24), 1, normalized=True, apart=lambda m: max(1, m // 4), length=100)
    return near.select(*S, "id", F.round(F.get("distances", F.lit(0)), 4).alias("distance"))


@query()
def m1_lof_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.lof_scores(v.hourly(spark, sf_dir), S, 24, 20, length=100).withColumn("score", R6(F.col("score")))


@query(f"""{TS}, p AS (SELECT series_id, t // 8 AS block, j, sum(value * cos(pi() * (t % 8 + 0.5) * j / 8)) AS s, count(*) AS n FROM ts, range(4) AS r(j) GROUP BY 1, 2, 3)
SELECT series_id, block, j::INTEGER AS j, round(CASE WHEN j = 0 THEN sqrt(1 / 8.0::DOUBLE) ELSE sqrt(2 / 8.0::DOUBLE) END * s, 6) AS coefficient FROM p WHERE n = 8""")
def m7_block_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return echo.block_cosines(v.series(spark, sf_dir), S, 8, 4).withColumn("coefficient", R6(F.col("coefficient")))


@query(f"""{SC}, i AS (SELECT series_id, t AS start, 5 + t % 4 AS length, score FROM scores WHERE instance = 'zscore' AND t % 3 = 0 AND score > 0.5)
SELECT s.series_id, s.t, round(coalesce(avg(i.score), 0), 9) AS score FROM (SELECT DISTINCT series_id, t FROM scores) s LEFT JOIN i ON s.series_id = i.series_id AND s.t >= start AND s.t < start + length GROUP BY 1, 2""")
def m8_covering_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = v.user_scores(spark, sf_dir).where("instance = 'zscore'")
    intervals = points.where("t % 3 = 0 and score > 0.5").select(*S, F.col("t").alias("start"), (5 + F.col("t") % 4).alias("length"), "score")
    return grammar.covering_mean_frame(intervals, points, S).withColumn("score", F.round("score", 9))


@query(f"""{TS}, p AS (SELECT series_id, t // 2 AS t, max(CASE WHEN t % 2 = 0 THEN value END) AS a, max(CASE WHEN t % 2 = 1 THEN value END) AS b FROM ts GROUP BY 1, 2)
SELECT series_id, t, round((a + b) / sqrt(2.0), 6) AS approximation, round((a - b) / sqrt(2.0), 6) AS detail FROM p WHERE b IS NOT NULL""")
def m6_haar_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.haar_frame(v.series(spark, sf_dir), S).select(*S, "t", R6(F.col("approximation")).alias("approximation"), R6(F.col("detail")).alias("detail"))


@query(f"""{TS} SELECT series_id, t // 16 AS block, (t % 16) * 4 // 16 AS segment, round(avg(value), 6) AS mean FROM ts GROUP BY 1, 2, 3""")
def m8_paa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.paa_frame(v.series(spark, sf_dir), S, 16, 4).withColumn("mean", R6(F.col("mean")))


@query(f"""{TS}, z AS (SELECT series_id, t, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-12) AS z FROM ts WINDOW w AS (PARTITION BY series_id)),
m AS (SELECT series_id, t // 4 AS word, round(avg(z), 6) AS m FROM z GROUP BY 1, 2)
SELECT series_id, word, CASE WHEN m < -0.67 THEN 'a' WHEN m < 0 THEN 'b' WHEN m < 0.67 THEN 'c' ELSE 'd' END AS letter FROM m""")
def m8_sax(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*S)
    z = v.series(spark, sf_dir).withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_pop("value").over(w), F.lit(1e-12)))
    means = z.groupBy(*S, F.floor(F.col("t") / 4).cast("long").alias("word")).agg(R6(F.avg("z")).alias("m"))
    return means.select(*S, "word", detectors.sax_letters(F.col("m"), 4).alias("letter"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.label, a.vec_id, b.vec_id AS o, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS n FROM d) SELECT label, vec_id AS id, round(max(d), 5) AS distance FROM n WHERE n <= 5 GROUP BY 1, 2""")
def m2_knn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = v.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return detectors.knn_frame(vectors, ["label"], 5).withColumn("distance", F.round("distance", 5))


# ---- injection


ARRAYS = "arr AS (SELECT series_id, list(value ORDER BY t) AS x, count(*) AS n FROM ts GROUP BY 1 HAVING count(*) >= 20)"
ROWS = "SELECT series_id, (generate_subscripts(y, 1) - 1)::BIGINT AS t, round(unnest(y), 6) AS value FROM res"


ROWS8 = ROWS.replace(", 6)", ", 8)")


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = v.series(spark, sf_dir).groupBy(*S).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("_r"))
    return a.where(F.size("_r") >= 20).select(*S, F.transform("_r", lambda r: r["value"]).alias("x"))


def _rows(df: DataFrame, y, digits: int = 6) -> DataFrame:
    return df.select(*S, F.posexplode(y).alias("t", "value")).select(*S, F.col("t").cast("long").alias("t"), F.round("value", digits).alias("value"))


@query(f"{TS},\n{ARRAYS}, res AS (SELECT series_id, list_reverse(x) AS y FROM arr) {ROWS}")
def i6_vmirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_arrays(spark, sf_dir), injection.vmirror(F.col("x")))


@query(f"{TS},\n{ARRAYS}, res AS (SELECT series_id, list_transform(x, lambda a: 2 * list_avg(x) - a) AS y FROM arr) {ROWS}")
def i7_hmirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_arrays(spark, sf_dir), injection.hmirror(F.col("x")))


@query(f"{TS},\n{ARRAYS}, res AS (SELECT series_id, list_transform(x, lambda a: a * 1.05) AS y FROM arr) {ROWS}")
def i8_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_arrays(spark, sf_dir), injection.scale(F.col("x"), 0.4))


def _resample_sql(m: str) -> str:
    at = f"(i * (n - 1)::DOUBLE / ({m} - 1))"
    return f"list_transform(range(0, {m}), lambda i: x[floor({at})::BIGINT + 1] + (x[least(floor({at})::BIGINT + 2, n)] - x[floor({at})::BIGINT + 1]) * ({at} - floor({at})))"


@query(f"{TS},\n{ARRAYS}, res AS (SELECT series_id, {_resample_sql('floor(n * 0.5)::BIGINT')} AS y FROM arr) {ROWS8}")
def i2_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_arrays(spark, sf_dir), injection.compress(F.col("x"), 0.5), 8)


@query(f"{TS},\n{ARRAYS}, res AS (SELECT series_id, {_resample_sql('floor(n * 1.625)::BIGINT')} AS y FROM arr) {ROWS8}")
def i3_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_arrays(spark, sf_dir), injection.stretch(F.col("x"), 0.5), 8)


_K = injection.gaussian_kernel(10, 0.5)


@query(f"""{TS},\n{ARRAYS}, res AS (SELECT series_id, list_transform(range(1, n + 1), lambda i: {' + '.join(f"coalesce(CASE WHEN i + {1 - k} >= 1 THEN x[i + {1 - k}] END, 0) * {w!r}" for k, w in enumerate(_K))}) AS y FROM arr) {ROWS}""")
def i5_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_arrays(spark, sf_dir), scalar.convolved(F.col("x"), _K))


@query(f"""{TS}, n AS (SELECT series_id, count(*) AS n FROM ts GROUP BY 1), l AS (SELECT series_id, n, unnest([5, 10, 20, floor(n / 10.0)::INTEGER]) AS l FROM n)
SELECT DISTINCT series_id, k.k AS anomaly_type, l AS length FROM l, (VALUES ('hmirror'), ('scale')) AS k(k) WHERE l > 0 AND l <= n * 0.2""")
def g14_injection_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = v.series(spark, sf_dir).groupBy(*S).agg(F.count(F.lit(1)).alias("n"))
    lengths = injection.admissible_lengths(F.col("n") / 10, F.col("n"), (5, 10, 20), (1.0,), 0.2)
    return injection.injection_plan(base, S, ["hmirror", "scale"], lengths)


@query()
def i0_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = v.series(spark, sf_dir).withColumn("is_anomaly", F.lit(False))
    sizes = base.groupBy(*S).agg(F.count(F.lit(1)).alias("n"))
    plan = injection.injection_plan(sizes, S, list(injection.TRANSFORMS), F.array(F.lit(8)))
    made = injection.inject_all(base, plan, S)
    return made.where("t = 0").select(*S, "anomaly_type", "length", injection.annotation_code(F.col("annotations")).alias("code"))


# ---- generation


@query(f"""{TS}, p AS (SELECT series_id, t, value, max(value) OVER a AS a, max(value) OVER b AS b, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM ts
  WINDOW w AS (PARTITION BY series_id ORDER BY t), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
c AS (SELECT series_id, count(*) FILTER (WHERE value > a AND value > b AND rn > 3 AND n - rn >= 3) AS peaks, count(*) AS n FROM p GROUP BY 1)
SELECT series_id, peaks, CASE WHEN peaks > 0 THEN n // peaks END AS period FROM c""")
def g1_peak_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.peak_period(v.series(spark, sf_dir), S, 3)


@query(f"""{TS}, a AS (SELECT series_id, t // 10 AS k, round(sum(abs(value)), 3) AS area FROM ts GROUP BY 1, 2),
c AS (SELECT *, lag(area) OVER (PARTITION BY series_id ORDER BY k) / area - 1 AS c FROM a),
g AS (SELECT series_id, min(area) AS lo, arg_min(k, area) AS am, max(c) AS hi, arg_max(k, c) AS ax FROM c GROUP BY 1)
SELECT series_id, CASE WHEN lo < 0.000001 THEN am WHEN coalesce(hi, 0) < 0.5 THEN 1 ELSE ax END AS k FROM g""")
def g3_choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = v.series(spark, sf_dir).groupBy(*S, F.floor(F.col("t") / 10).cast("long").alias("k")).agg(F.round(F.sum(F.abs("value")), 3).alias("area"))
    return generation.choose_k(areas, S)


@query(f"""{TS}, n AS (SELECT series_id, count(*) AS n FROM ts GROUP BY 1) SELECT series_id, CASE WHEN series_id % 100 > 60 THEN 'too long' WHEN series_id % 100 < 6 THEN 'too short' WHEN series_id % 100 >= 0.1 * n THEN 'too large a part' END AS fault FROM n""")
def f15_period_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = v.series(spark, sf_dir).groupBy(*S).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*S, generation.period_fault(F.col("series_id") % 100, F.col("n"), 60).alias("fault"))


@query()
def g4_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly values: summed up in the first half of the series, as they are in the second; where that changes is a cut."""
    hours = v.hourly(spark, sf_dir).withColumn("half", F.floor(F.max("t").over(Window.partitionBy(*S)) / 2))
    centred = hours.withColumn("off", F.col("value") - F.avg("value").over(Window.partitionBy(*S)))
    summed = F.sum("off").over(Window.partitionBy(*S).orderBy("t"))
    points = centred.withColumn("value", F.when(F.col("t") < F.col("half"), summed).otherwise(F.col("off"))).withColumn("period", F.lit(24))
    return generation.regimes(generation.regime_kernel(points, S, "period", 2), S, 24)


@query()
def g11_cleaning_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = generation.cleaning_votes(v.user_scores(spark, sf_dir), S, F.lit(10))
    return generation.voted_cuts(votes, S, 5)


@query(f"""{TS}, stretches AS (SELECT series_id, min(t) AS b, max(t) + 1 AS e FROM (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS run FROM ts WHERE NOT is_anomaly) GROUP BY series_id, run),
placed AS (SELECT *, 60 - coalesce(sum(e - b) OVER (PARTITION BY series_id ORDER BY e - b DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM stretches),
chosen AS (SELECT series_id, b, least(e, b + room) AS e FROM placed WHERE room > 0)
SELECT ts.series_id, row_number() OVER (PARTITION BY ts.series_id ORDER BY t) - 1 AS t, t AS t_orig, value FROM ts JOIN chosen c ON ts.series_id = c.series_id AND t >= b AND t < e""")
def g12_label_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = v.series(spark, sf_dir)
    cuts = slices.mask_to_slices(points, S, "is_anomaly")
    return generation.cleaned(points, cuts, S, points.select(*S).distinct().withColumn("limit", F.lit(60)))


# ---- search


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = v.quality(spark, sf_dir)
    params = F.create_map(F.lit("window"), (F.col("series_id") % 7).cast("double"), F.lit("k"), F.lit(5.0))
    return q.select(F.col("instance").alias("algorithm"), (F.col("series_id") % 20).alias("dataset"), F.col("series_id").alias("trial"), params.alias("params"), "quality")


STATE_SQL = f"WITH {v.QUALITY_SQL}, tr AS (SELECT instance AS algorithm, series_id % 20 AS dataset, series_id AS trial, (series_id % 7)::DOUBLE AS w, quality FROM quality), state AS (SELECT algorithm, dataset, 'active' AS status, count(*) AS n_completed, 10::BIGINT AS n_desired, max(quality) AS best_score FROM tr GROUP BY 1, 2)"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir).groupBy("algorithm", "dataset").agg(F.lit("active").alias("status"), F.count(F.lit(1)).alias("n_completed"), F.lit(10).cast("long").alias("n_desired"), F.max("quality").alias("best_score"))


@query(f"{STATE_SQL} SELECT * FROM state WHERE status = 'active' AND n_desired > n_completed")
def f12_open_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimization.open_searches(_state(spark, sf_dir))


@query(f"{STATE_SQL}, g AS (SELECT algorithm, dataset, count(*) FILTER (WHERE quality >= 0.6) AS good FROM tr GROUP BY 1, 2) SELECT s.algorithm, s.dataset, CASE WHEN good >= 3 THEN 'max_quality' WHEN n_completed >= 8 THEN 'max_trials' ELSE 'active' END AS status FROM state s JOIN g USING (algorithm, dataset)")
def o6_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimization.stopped(_state(spark, sf_dir), _trials(spark, sf_dir), 8, 0.6, 3).select("algorithm", "dataset", "status")


@query(f"{STATE_SQL} SELECT algorithm, dataset, CASE WHEN row_number() OVER (PARTITION BY dataset ORDER BY best_score, algorithm) = 1 AND count(*) OVER (PARTITION BY dataset) > 1 THEN 'algo_pruned' ELSE status END AS status FROM state")
def o7_prune_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimization.prune_worst(_state(spark, sf_dir)).select("algorithm", "dataset", "status")


WON = "won AS (SELECT algorithm, dataset FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY best_score DESC, algorithm) AS n FROM state) WHERE n = 1)"


@query(f"{STATE_SQL}, {WON} SELECT * FROM won")
def o10_best_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimization.best_algorithms(_state(spark, sf_dir)).select("algorithm", "dataset")


INSTANCES = "inst AS (SELECT algorithm, w, count(DISTINCT dataset) AS no_datasets FROM (SELECT t.*, row_number() OVER (PARTITION BY t.algorithm, t.dataset ORDER BY quality DESC, w) AS n FROM tr t JOIN won USING (algorithm, dataset)) WHERE n = 1 GROUP BY 1, 2)"


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimization.best_instances(_trials(spark, sf_dir), optimization.best_algorithms(_state(spark, sf_dir)))


@query(f"{STATE_SQL}, {WON}, {INSTANCES} SELECT algorithm, w AS window, no_datasets FROM inst")
def o10_best_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instances(spark, sf_dir).select("algorithm", F.col("params")["window"].alias("window"), "no_datasets")


@query(f"{STATE_SQL}, {WON}, {INSTANCES} SELECT algorithm, w AS window, no_datasets FROM inst UNION ALL SELECT a, 3.0::DOUBLE, 0 FROM (SELECT DISTINCT algorithm AS a FROM state) WHERE a NOT IN (SELECT algorithm FROM inst WHERE w = 3)")
def o11_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = _state(spark, sf_dir).select("algorithm").distinct().withColumn("params", F.create_map(F.lit("k"), F.lit(5.0), F.lit("window"), F.lit(3.0)))
    return optimization.with_defaults(_instances(spark, sf_dir), defaults).select("algorithm", F.col("params")["window"].alias("window"), "no_datasets")


@query(f"{STATE_SQL}, {WON}, {INSTANCES}, m AS (SELECT algorithm, w, round(avg(quality), 9) AS mean FROM tr GROUP BY 1, 2) SELECT algorithm, w AS window, no_datasets, row_number() OVER (PARTITION BY algorithm ORDER BY no_datasets DESC, mean DESC, w) - 1 AS position FROM inst JOIN m USING (algorithm, w)")
def o13_final_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = _trials(spark, sf_dir).groupBy("algorithm", F.col("params")["window"].alias("window")).agg(F.round(F.avg("quality"), 9).alias("mean_train_quality"))
    found = _instances(spark, sf_dir).select("algorithm", F.col("params")["window"].alias("window"), "no_datasets").join(mean, ["algorithm", "window"])
    return optimization.final_order(found.withColumn("params_json", F.col("window").cast("string")), ["algorithm"]).select("algorithm", "window", "no_datasets", "position")


@query()
def o8_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimization.consolidated(_trials(spark, sf_dir)).select("algorithm", "params_id", F.size("datasets").cast("long").alias("n"))


@query(f"{STATE_SQL} SELECT trial, quality FROM tr b WHERE dataset >= 10 AND EXISTS (SELECT 1 FROM tr a WHERE a.dataset < 10 AND a.w = b.w)")
def u5_binned_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trials(spark, sf_dir)
    return optimization.binned_common(t.where("dataset < 10"), t.where("dataset >= 10")).select("trial", "quality")


@query(f"{STATE_SQL} SELECT trial, algorithm FROM tr b WHERE dataset >= 10 AND EXISTS (SELECT 1 FROM tr a WHERE a.dataset < 10 AND abs(a.quality - b.quality) <= 1e-5)")
def u4_tolerant_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trials(spark, sf_dir)
    return optimization.tolerant_common(t.where("dataset < 10"), t.where("dataset >= 10"), "quality", 1e-5).select("trial", "algorithm")


@query()
def o1_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = v.series(spark, sf_dir).select(*S).distinct().select(*S, F.explode(F.array(*[F.struct(F.lit(a).alias("algorithm"), F.lit(json.dumps({"window_size": w})).alias("params_json")) for a in ("kmeans", "stomp") for w in (5, 10)])).alias("j"))
    return optimization.run_trials(v.series(spark, sf_dir), jobs.select(*S, "j.*"), S).drop("duration")


def _cluster_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The qualities of the table's series as trials of k-means, by dataset, numbered in the order of the series."""
    q = v.quality(spark, sf_dir).where("instance = 'zscore'").select((F.col("series_id") % 5).alias("dataset"), F.lit("kmeans").alias("algorithm"), "series_id", "quality")
    params = F.to_json(F.struct((F.col("series_id") % 49 + 2).alias("n_clusters"), (F.col("series_id") % 90 + 10).alias("window_size")))
    number = F.row_number().over(Window.partitionBy("dataset").orderBy("series_id")) - 1
    return q.select("dataset", "algorithm", number.cast("long").alias("number"), params.alias("params_json"), "quality")


@query()
def o2_next_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = _cluster_trials(spark, sf_dir)
    asked = studies.next_trials(trials.select("dataset", "algorithm").distinct(), trials, ["dataset"], 4, startup=4)
    return asked.select("dataset", "algorithm", "number", F.get_json_object("params_json", "$.window_size").cast("long").alias("window_size"), F.get_json_object("params_json", "$.n_clusters").cast("long").alias("n_clusters"))


@query()
def o3_study_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of studies of two detectors on the hourly series, with its period's and the known settings first."""
    series = v.hourly(spark, sf_dir)
    wanted = series.select(*S).distinct().select(*S, F.explode(F.array(F.lit("dwt_mlead"), F.lit("kmeans"))).alias("algorithm"), F.lit(24).alias("period"))
    log = studies.TrialLog(spark, studies.scratch(spark, "trials"))
    return studies.run_studies(series, wanted, S, log, 2, 4, startup=2).select(*S, "algorithm", "round", "number", "params_json", R6(F.col("quality")).alias("quality"))


@query()
def o6_regret_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.remaining_improvement(_cluster_trials(spark, sf_dir), ["dataset"], 5).withColumn("bound", R6(F.col("bound")))


# ---- selective ensembles


@query(f"""{SC}, p AS (SELECT a.series_id, a.score AS x, b.score AS y, 1.0 / (a.t + 1) AS w FROM scores a JOIN scores b ON a.series_id = b.series_id AND a.t = b.t AND a.instance = 'zscore' AND b.instance = 'diff'),
s AS (SELECT series_id, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS xy, sum(w * x * x) AS xx, sum(w * y * y) AS yy FROM p GROUP BY 1)
SELECT series_id, round(CASE WHEN xx - sx * sx / sw > 1e-12 AND yy - sy * sy / sw > 1e-12 THEN (xy - sx * sy / sw) / sqrt((xx - sx * sx / sw) * (yy - sy * sy / sw)) ELSE 0.0 END, 5) AS r FROM s""")
def b1_weighted_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = v.features(v.series(spark, sf_dir))
    return selective.weighted_correlation(wide, S, F.col("zscore"), F.col("diff"), 1.0 / (F.col("t") + 1)).withColumn("r", F.round("r", 5))


@query(f"""{SC}, r AS (SELECT series_id, instance, t, count(*) OVER (PARTITION BY series_id, instance ORDER BY score RANGE UNBOUNDED PRECEDING) AS r FROM scores)
SELECT series_id, instance, t, round(1.0 / (max(r) OVER (PARTITION BY series_id) - r + 1), 6) AS score FROM r""")
def b9_rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsquorum.operators import ranks

    return ranks.rank_scores(selective.base_ranks(v.user_scores(spark, sf_dir), S)).select(*S, "instance", "t", R6(F.col("score")).alias("score"))


@query()
def b7_selective_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selective.select_series(v.user_scores(spark, sf_dir), S).withColumn("score", R6(F.col("score")))
