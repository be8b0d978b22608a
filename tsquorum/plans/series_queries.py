"""Queries over series and scores: slices, views, normalization, thresholds, ensembles, metrics, distances, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsquorum.functions import scalar
from tsquorum.operators import distances, metrics, ranks, scores, selection, slices, views as windows
from tsquorum.plans import views as v
from tsquorum.plans import registry
from tsquorum.plans.registry import query

S = v.SERIES
R6 = lambda c: F.round(c, 6)
TS = f"WITH {v.SERIES_SQL}"
SC = f"WITH {v.SERIES_SQL},\n{v.SCORES_SQL}"
ISLANDS = "islands AS (SELECT series_id, min(t)::BIGINT AS b, max(t)::BIGINT + 1 AS e FROM (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS run FROM ts WHERE is_anomaly) GROUP BY series_id, run)"
LENGTHS = "lengths AS (SELECT series_id, count(*) AS n FROM ts GROUP BY 1)"


def _pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.series(spark, sf_dir)


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.mask_to_slices(_pts(spark, sf_dir), S, "is_anomaly")


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pts(spark, sf_dir).groupBy(*S).agg(F.count(F.lit(1)).alias("n"))


# ---- the flagship: ensemble a score matrix and report the detected ranges


def detected_ranges(points: DataFrame, scored: DataFrame, normalization: str = "minmax") -> DataFrame:
    together = scores.combined(scored, S, normalization, "custom").withColumn("score", R6(F.col("score")))
    flagged = together.withColumn("flag", F.col("score") > 0)
    found = slices.mask_to_slices(flagged, S)
    peak = flagged.join(found.select(*S, "b", F.explode(F.sequence("b", F.col("e") - 1)).alias("t")), [*S, "t"]).groupBy(*S, "b").agg(F.max("score").alias("peak"))
    return found.join(peak, [*S, "b"]).select(*S, "b", "e", "peak")


ENSEMBLE = """stats AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WINDOW w AS (PARTITION BY series_id, instance)),
scaled AS (SELECT series_id, instance, t, is_anomaly, (score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS score FROM stats),
thresholds AS (SELECT *, avg(score) OVER w + 2 * stddev_pop(score) OVER w AS th FROM scaled WINDOW w AS (PARTITION BY series_id, instance)),
combined AS (SELECT series_id, t, round(max(CASE WHEN score >= th THEN score - th ELSE 0 END), 6) AS score FROM thresholds GROUP BY 1, 2),
flagged AS (SELECT *, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS run FROM combined WHERE score > 0)
SELECT series_id, min(t)::BIGINT AS b, max(t)::BIGINT + 1 AS e, max(score) AS peak FROM flagged GROUP BY series_id, run"""


@query(f"WITH {v.HOURLY_SQL},\n{v.SCORES_SQL},\n{ENSEMBLE}")
def ensemble_ranges_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = v.hourly(spark, sf_dir)
    return detected_ranges(points, v.scores(points))


@query(f"{SC},\n{ENSEMBLE}")
def ensemble_ranges_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _pts(spark, sf_dir)
    return detected_ranges(points, v.scores(points))


# ---- slices and masks


@query(f"{TS},\n{ISLANDS} SELECT * FROM islands")
def f2_mask_to_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir)


@query(f"{TS} SELECT series_id, t, is_anomaly AS flag FROM ts")
def f3_slices_to_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.slices_to_mask(_islands(spark, sf_dir), _lengths(spark, sf_dir), S)


@query(f"""{TS},\n{ISLANDS} SELECT series_id, e AS b, coalesce(lead(b) OVER w, first_value(b) OVER w) AS e FROM islands WINDOW w AS (PARTITION BY series_id ORDER BY b)""")
def f4_invert_slices_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.invert_slices(_islands(spark, sf_dir), S)


@query(f"""{TS},\n{LENGTHS},
gaps AS (SELECT series_id, min(t)::BIGINT AS b, max(t)::BIGINT + 1 AS e FROM (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS run FROM ts WHERE NOT is_anomaly) GROUP BY series_id, run)
SELECT * FROM gaps""")
def f4_invert_slices_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.invert_slices(_islands(spark, sf_dir), S, _lengths(spark, sf_dir))


@query(f"{TS},\n{ISLANDS} SELECT series_id, b, e, e - b AS length FROM islands")
def f5_slice_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.slice_lengths(_islands(spark, sf_dir))


@query(f"{TS} SELECT series_id, t AS t_orig, value, is_anomaly, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS t FROM ts WHERE NOT is_anomaly")
def f6_remove_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.remove_slices(_pts(spark, sf_dir), _islands(spark, sf_dir), S)


@query(f"{TS} SELECT series_id, t, value FROM ts WHERE NOT is_anomaly")
def f1_mask_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pts(spark, sf_dir).where(~F.col("is_anomaly")).select(*S, "t", "value")


@query(f"""{TS}, kept AS (SELECT series_id, t AS o, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS t, lag(t) OVER (PARTITION BY series_id ORDER BY t) AS p FROM ts WHERE NOT is_anomaly)
SELECT series_id, t FROM kept WHERE t > 0 AND p <> o - 1""")
def d7_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.cut_points(_pts(spark, sf_dir).where(~F.col("is_anomaly")).withColumnRenamed("t", "t_orig"), S)


@query(f"""{TS},\n{ISLANDS}, ordered AS (SELECT *, coalesce(sum(e - b) OVER (PARTITION BY series_id ORDER BY e - b DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM islands)
SELECT series_id, b, least(e, b + 5 - before)::BIGINT AS e FROM ordered WHERE before < 5""")
def k7_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.longest_first(_islands(spark, sf_dir), S, F.lit(5))


@query(f"""{TS},\n{ISLANDS}, far AS (SELECT *, CASE WHEN b - lag(e) OVER w < 3 THEN 0 ELSE 1 END AS f FROM islands WINDOW w AS (PARTITION BY series_id ORDER BY b)),
grouped AS (SELECT *, sum(f) OVER (PARTITION BY series_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS g FROM far)
SELECT series_id, min(b)::BIGINT AS b, max(e)::BIGINT AS e FROM grouped GROUP BY series_id, g""")
def g4_close_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.close_gaps(_islands(spark, sf_dir), S, F.lit(3))


@query(f"""{TS},\n{ISLANDS} SELECT t.series_id, t.t FROM ts t WHERE EXISTS (SELECT 1 FROM islands i WHERE i.series_id = t.series_id AND t.t >= greatest(i.b - 2, 0) AND t.t < i.e + 2)""")
def j18_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.inside_slices(_pts(spark, sf_dir).select(*S, "t"), _islands(spark, sf_dir), S, 2)


@query(f"""{TS},\n{ISLANDS}, per AS (SELECT series_id, count(*) AS num_anomalies, min(e - b)::BIGINT AS min_length, max(e - b)::BIGINT AS max_length, round(median(e - b), 6) AS median_length FROM islands GROUP BY 1)
SELECT series_id, count(*) AS length, round(avg(CASE WHEN is_anomaly THEN 1.0 ELSE 0.0 END), 6) AS contamination, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev,
  coalesce(num_anomalies, 0) AS num_anomalies, min_length, max_length, median_length FROM ts LEFT JOIN per USING (series_id) GROUP BY series_id, num_anomalies, min_length, max_length, median_length""")
def a27_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = slices.slice_lengths(_islands(spark, sf_dir)).groupBy(*S).agg(
        F.count(F.lit(1)).alias("num_anomalies"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), R6(F.median("length")).alias("median_length"))
    per = _pts(spark, sf_dir).groupBy(*S).agg(F.count(F.lit(1)).alias("length"), R6(F.avg(F.col("is_anomaly").cast("double"))).alias("contamination"), R6(F.avg("value")).alias("mean"), R6(F.stddev_pop("value")).alias("stddev"))
    return per.join(lengths, S, "left").withColumn("num_anomalies", F.coalesce("num_anomalies", F.lit(0)))


# ---- windowed views


@query(f"""{TS}, w AS (SELECT series_id, t, avg(value) OVER x AS m, count(*) OVER x AS n FROM ts WINDOW x AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT series_id, t, round(m, 6) AS window_mean FROM w WHERE n = 10""")
def v1_sliding_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.sliding(_pts(spark, sf_dir), S, 10)
    return w.select(*S, "t", R6(F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 10).alias("window_mean"))


@query(f"""{TS}, w AS (SELECT series_id, t, max(value) OVER x AS score, count(*) OVER x AS n FROM ts WINDOW x AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
s AS (SELECT ts.series_id, ts.t, w.score FROM ts LEFT JOIN w ON w.series_id = ts.series_id AND w.t = ts.t AND w.n = 10),
c AS (SELECT series_id, t, avg(score) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, min(score) OVER (PARTITION BY series_id) AS lo FROM s)
SELECT series_id, t, round(coalesce(m, lo), 6) AS score FROM c""")
def w6_reverse_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _pts(spark, sf_dir)
    scored = windows.sliding(points, S, 10).select(*S, "t", F.array_max("window").alias("score"))
    return windows.reverse_sliding(scored, points, S, 10).withColumn("score", R6(F.col("score")))


@query(f"""{TS} SELECT series_id, t // 16 AS block, round(sum(value) / 16, 6) AS block_mean FROM ts GROUP BY 1, 2""")
def v2_tumbling_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.tumbling(_pts(spark, sf_dir), S, 16)
    return w.select(*S, "block", R6(F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 16).alias("block_mean"))


@query(f"""{TS}, b AS (SELECT series_id, t // 16 AS block, avg(is_anomaly::INT) AS score FROM ts GROUP BY 1, 2),
f AS (SELECT series_id, block + k AS block, avg(1 - score) AS s FROM b, (VALUES (0), (1)) AS o(k) GROUP BY 1, 2)
SELECT ts.series_id, ts.t, round(coalesce(f.s, min(f.s) OVER (PARTITION BY ts.series_id)), 6) AS score FROM ts LEFT JOIN f ON f.series_id = ts.series_id AND f.block = ts.t // 16""")
def v3_reverse_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _pts(spark, sf_dir)
    blocks = points.groupBy(*S, F.floor(F.col("t") / 16).cast("long").alias("block")).agg(F.avg(F.col("is_anomaly").cast("int")).alias("score"))
    return windows.reverse_tumbling(blocks, points, S, 16, 1).withColumn("score", R6(F.col("score")))


@query(f"""{TS},\n{ISLANDS}, spread AS (SELECT series_id, e - b AS score, unnest(generate_series(b, e + 1)) AS t FROM islands)
SELECT ts.series_id, ts.t, round(coalesce(avg(score::DOUBLE), 0), 6) AS score FROM ts LEFT JOIN spread s ON s.series_id = ts.series_id AND s.t = ts.t GROUP BY 1, 2""")
def v4_reverse_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = slices.slice_lengths(_islands(spark, sf_dir)).select(*S, "b", (F.col("e") + 2).alias("e"), F.col("length").cast("double").alias("score"))
    return windows.reverse_intervals(scored, _pts(spark, sf_dir), S).withColumn("score", R6(F.col("score")))


@query(f"WITH {v.SERIES_SQL} SELECT series_id, t, ntile(4) OVER w AS quarter, lag(value) OVER w AS before, lead(value) OVER w AS after, first_value(value) OVER whole AS first, last_value(value) OVER whole AS last FROM ts WINDOW w AS (PARTITION BY series_id ORDER BY t), whole AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def w12_window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("series_id").orderBy("t")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return v.series(spark, sf_dir).select(
        "series_id", "t", F.ntile(4).over(order).cast("long").alias("quarter"), F.lag("value").over(order).alias("before"), F.lead("value").over(order).alias("after"),
        F.first("value").over(whole).alias("first"), F.last("value").over(whole).alias("last"))


@query(f"""{TS}, e AS (SELECT series_id, t, abs(value - coalesce(lag(value) OVER (PARTITION BY series_id ORDER BY t), value)) AS error FROM ts),
s AS (SELECT series_id, t, avg(error) OVER p AS pm, stddev_pop(error) OVER p AS ps, avg(error) OVER f AS fm FROM e
  WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT series_id, t, round(coalesce(abs(fm - pm), 0), 6) AS shift FROM s""")
def w8_past_and_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy(*S).orderBy("t")
    errors = _pts(spark, sf_dir).withColumn("error", F.abs(F.col("value") - F.coalesce(F.lag("value").over(order), F.col("value"))))
    w = windows.past_and_future(errors, S, 5, 30)
    return w.select(*S, "t", R6(F.coalesce(F.abs(F.col("future_mean") - F.col("past_mean")), F.lit(0.0))).alias("shift"))


@query(f"""{TS}, n AS (SELECT series_id, t, value, count(*) OVER (PARTITION BY series_id) AS n FROM ts) SELECT series_id, (t + 10 - n % 10) // 10 AS block, max(value) AS value FROM n GROUP BY 1, 2""")
def e14_downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.spread_blocks(_pts(spark, sf_dir), S, 10, "value")


# ---- scores


@query(f"{SC} SELECT series_id, instance, t, score FROM scores")
def s7_score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.finite_instances(v.user_scores(spark, sf_dir), S).select(*S, "instance", "t", "score")


@query(f"""{SC}, bad AS (SELECT DISTINCT series_id, instance FROM scores WHERE score > 1000) SELECT s.series_id, s.instance, count(*) AS n FROM scores s LEFT JOIN bad b USING (series_id, instance) WHERE b.instance IS NULL GROUP BY 1, 2""")
def f7_finite_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.user_scores(spark, sf_dir).withColumn("score", F.when(F.col("score") > 1000, F.lit(float("inf"))).otherwise(F.col("score")))
    return scores.finite_instances(s, S).groupBy(*S, "instance").agg(F.count(F.lit(1)).alias("n"))


MINMAX = "stats AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WINDOW w AS (PARTITION BY series_id, instance)), scaled AS (SELECT series_id, instance, t, is_anomaly, (score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS score FROM stats)"


@query(f"{SC},\n{MINMAX} SELECT series_id, instance, t, round(score, 6) AS score FROM scaled")
def n1_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.minmax(v.user_scores(spark, sf_dir), S).select(*S, "instance", "t", R6(F.col("score")).alias("score"))


@query(f"""{SC}, stats AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WINDOW w AS (PARTITION BY series_id, instance)),
pre AS (SELECT series_id, instance, t, CASE WHEN lo = 0 AND hi > 1 THEN score / hi ELSE score END AS x FROM stats),
z AS (SELECT series_id, instance, t, (x - avg(x) OVER w) / (CASE WHEN stddev_pop(x) OVER w = 0 THEN 1e-12 ELSE stddev_pop(x) OVER w END * sqrt(2.0)) AS z FROM pre WINDOW w AS (PARTITION BY series_id, instance))
SELECT series_id, instance, t, round(greatest({scalar.erf_sql("z")}, 0.0), 5) AS score FROM z""")
def n2_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.gaussian(v.user_scores(spark, sf_dir), S).select(*S, "instance", "t", F.round("score", 5).alias("score"))


@query(f"""{SC}, m AS (SELECT *, median(score) OVER w AS mid, min(score) OVER w AS lo, max(score) OVER w AS hi FROM (SELECT series_id, instance, t, score + (series_id % 2) AS score FROM scores) WINDOW w AS (PARTITION BY series_id, instance))
SELECT 'regular' AS mode, series_id, instance, t, round(greatest(score - mid, 0), 7) AS score FROM m UNION ALL SELECT 'inverse-linear', series_id, instance, t, round(hi - score, 7) FROM m
UNION ALL SELECT 'inverse-log', series_id, instance, t, round(CASE WHEN lo > 0 THEN -ln(CASE WHEN lo > 0 THEN score / hi ELSE 1 END) ELSE hi - score END, 7) FROM m""")
def n2b_regularized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes; scores of every other series are raised by 1, so that some have logarithms."""
    s = v.user_scores(spark, sf_dir).withColumn("score", F.col("score") + F.col("series_id") % 2)
    parts = [scores.regularized(s, S, mode).select(F.lit(mode).alias("mode"), *S, "instance", "t", (F.round("score", 7) + 0.0).alias("score")) for mode in ("regular", "inverse-linear", "inverse-log")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{SC} SELECT series_id, instance, round(avg(score) + 2 * stddev_pop(score), 6) AS threshold FROM scores GROUP BY 1, 2""")
def t1_sigma_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.user_scores(spark, sf_dir).withColumn("threshold", R6(scores.sigma_threshold(S))).groupBy(*S, "instance").agg(F.max("threshold").alias("threshold"))


@query(f"""{SC} SELECT series_id, instance, round(quantile_cont(score, 0.9), 7) AS threshold FROM scores GROUP BY 1, 2""")
def t2_percentile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.user_scores(spark, sf_dir).withColumn("threshold", F.round(scores.percentile_threshold(S), 7)).groupBy(*S, "instance").agg(F.max("threshold").alias("threshold"))


@query(f"""{SC}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, instance ORDER BY score) AS rn, count(*) OVER (PARTITION BY series_id, instance) AS n FROM scores),
h AS (SELECT *, least(greatest((n + 1.0 / 3) * 0.9 + 1.0 / 3, 1.0), n) AS h FROM r),
g AS (SELECT series_id, instance, max(CASE WHEN rn = floor(h) THEN score END) AS lo, max(CASE WHEN rn = floor(h) + 1 THEN score END) AS hi, max(h - floor(h)) AS p FROM h GROUP BY 1, 2)
SELECT series_id, instance, round(lo + p * (coalesce(hi, lo) - lo), 5) AS threshold FROM g""")
def t3_median_unbiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.median_unbiased(v.user_scores(spark, sf_dir), [*S, "instance"], 0.9).withColumn("threshold", F.round("threshold", 5))


@query(f"{SC},\n{MINMAX} SELECT series_id, t, round(max(score), 6) AS score FROM scaled GROUP BY 1, 2")
def a1_ensemble_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.combined(v.user_scores(spark, sf_dir), S, "minmax", "max").withColumn("score", R6(F.col("score")))


@query(f"{SC},\n{MINMAX} SELECT series_id, t, round(avg(score), 6) AS score FROM scaled GROUP BY 1, 2")
def a2_ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.combined(v.user_scores(spark, sf_dir), S, "minmax", "mean").withColumn("score", R6(F.col("score")))


@query(f"""{SC},\n{MINMAX}, th AS (SELECT *, avg(score) OVER w + 2 * stddev_pop(score) OVER w AS th FROM scaled WINDOW w AS (PARTITION BY series_id, instance))
SELECT series_id, t, round(max(CASE WHEN score >= th THEN score - th ELSE 0 END), 6) AS score FROM th GROUP BY 1, 2""")
def a3_ensemble_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.combine_excess(v.user_scores(spark, sf_dir), S).withColumn("score", R6(F.col("score")))


@query("""SELECT user_id, event_type AS majority FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1""")
def a4_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "events").groupBy("user_id").agg(scores.majority(F.col("event_type")).alias("majority"))


PREDICTED = "pred AS (SELECT *, score >= avg(score) OVER w + 2 * stddev_pop(score) OVER w AS p FROM scores WINDOW w AS (PARTITION BY series_id, instance))"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.predicted(v.user_scores(spark, sf_dir), scores.sigma_threshold(S))


@query(f"""{SC},\n{PREDICTED}, v AS (SELECT series_id, t, sum(p::INT)::BIGINT AS votes, count(*) AS n FROM pred GROUP BY 1, 2) SELECT series_id, t, votes, votes < n * 0.7 AS below FROM v""")
def a12_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _predicted(spark, sf_dir).groupBy(*S, "t").agg(F.sum(F.col("predicted").cast("long")).alias("votes"), F.count(F.lit(1)).alias("_n"))
    return votes.select(*S, "t", "votes", (F.col("votes") < F.col("_n") * 0.7).alias("below"))


@query(f"{SC},\n{PREDICTED} SELECT series_id, t, bool_or(p) AS predicted FROM pred GROUP BY 1, 2")
def a15_any_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).groupBy(*S, "t").agg(F.bool_or("predicted").alias("predicted"))


# ---- metrics


CONFUSION = """c AS (SELECT series_id, instance, count(*) FILTER (WHERE is_anomaly AND p) AS tp, count(*) FILTER (WHERE NOT is_anomaly AND p) AS fp,
  count(*) FILTER (WHERE is_anomaly AND NOT p) AS fn, count(*) FILTER (WHERE NOT is_anomaly AND NOT p) AS tn FROM pred GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re FROM c)"""


@query(f"""{SC},\n{PREDICTED},\n{CONFUSION} SELECT series_id, instance, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall,
  round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM m""")
def e9_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.confusion(_predicted(spark, sf_dir), [*S, "instance"])
    return c.select(*S, "instance", *[R6(F.col(n)).alias(n) for n in ("accuracy", "precision", "recall")], R6(F.col("f_beta")).alias("f1"))


@query(f"""{SC},\n{PREDICTED},\n{CONFUSION} SELECT series_id, instance, round(CASE WHEN pr + re > 0 THEN 101 * pr * re / (100 * pr + re) ELSE 0.0 END, 6) AS f10 FROM m""")
def e10_cleaning_f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _predicted(spark, sf_dir).withColumn("keep", ~F.col("predicted"))
    return metrics.cleaning_quality(points, [*S, "instance"]).select(*S, "instance", R6(F.col("f10")).alias("f10"))


@query(f"""{SC},\n{PREDICTED},\n{ISLANDS}, any_p AS (SELECT series_id, t, bool_or(p) AS p FROM pred GROUP BY 1, 2),
hit AS (SELECT i.series_id, i.b, bool_or(a.p) AS h FROM islands i LEFT JOIN any_p a ON a.series_id = i.series_id AND a.p AND a.t >= greatest(i.b - 2, 0) AND a.t < i.e + 2 GROUP BY 1, 2)
SELECT series_id, round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END), 6) AS hit_percentage FROM hit GROUP BY 1""")
def e1_hit_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _predicted(spark, sf_dir).groupBy(*S, "t").agg(F.bool_or("predicted").alias("predicted"), F.bool_or("is_anomaly").alias("is_anomaly"))
    return metrics.hit_percentage(points, S, 2).withColumn("hit_percentage", R6(F.col("hit_percentage")))


RANGES = """rs AS (SELECT s.series_id, s.instance, i.b, max(s.score) AS score FROM scaled s JOIN islands i ON i.series_id = s.series_id AND s.t >= greatest(i.b - 1, 0) AND s.t < i.e + 1 GROUP BY 1, 2, 3)"""


def _range_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.range_scores(scores.minmax(v.user_scores(spark, sf_dir), S), _pts(spark, sf_dir), S, 1)


@query(f"""{SC},\n{MINMAX},\n{ISLANDS},\n{RANGES} SELECT series_id, round(avg(best), 6) AS quality FROM (SELECT series_id, b, max(score) AS best FROM rs GROUP BY 1, 2) GROUP BY 1""")
def e4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality(_range_scores(spark, sf_dir), S).withColumn("quality", R6(F.col("quality")))


@query(f"""{SC},\n{MINMAX},\n{ISLANDS},\n{RANGES} SELECT series_id, round(avg(d), 6) AS variance FROM (SELECT series_id, b, stddev_samp(score) AS d FROM rs GROUP BY 1, 2) GROUP BY 1""")
def e5_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variance(_range_scores(spark, sf_dir), S).withColumn("variance", R6(F.col("variance")))


@query(f"""{SC},\n{MINMAX},\n{ISLANDS},\n{RANGES}, rel AS (SELECT series_id, instance, avg(score) AS r FROM rs GROUP BY 1, 2),
rk AS (SELECT DISTINCT instance, dense_rank() OVER (ORDER BY instance) - 1 AS k FROM scores)
SELECT series_id, round(sum(r / log2(k + 2)), 6) AS dcg FROM rel JOIN rk USING (instance) GROUP BY 1""")
def e6_dcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.user_scores(spark, sf_dir)
    ranking = s.select(*S, "instance").distinct().withColumn("rank", F.array_position(F.lit(sorted(v.INSTANCES)), F.col("instance")) - 1)
    return metrics.dcg(_range_scores(spark, sf_dir), ranking, S).withColumn("dcg", R6(F.col("dcg")))


CURVE = """per AS (SELECT series_id, instance, score, sum(is_anomaly::INT) AS p, sum((NOT is_anomaly)::INT) AS n FROM scores GROUP BY 1, 2, 3),
curve AS (SELECT series_id, instance, score, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER w AS pos, sum(n) OVER w AS neg FROM per
  WINDOW d AS (PARTITION BY series_id, instance ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY series_id, instance))"""


@query(f"""{SC},\n{CURVE}, a AS (SELECT *, (fp - coalesce(lag(fp) OVER d, 0)) * (tp + coalesce(lag(tp) OVER d, 0)) / 2 AS area FROM curve WINDOW d AS (PARTITION BY series_id, instance ORDER BY score DESC))
SELECT series_id, instance, round(CASE WHEN max(pos) * max(neg) > 0 THEN sum(area) / (max(pos) * max(neg)) END, 6) AS roc_auc FROM a GROUP BY 1, 2""")
def e11_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(v.user_scores(spark, sf_dir), [*S, "instance"]).withColumn("roc_auc", R6(F.col("roc_auc")))


@query(f"""{SC},\n{CURVE}, r AS (SELECT *, tp / (tp + fp) AS pr, tp / pos AS re FROM curve WHERE pos > 0),
a AS (SELECT *, (re - coalesce(lag(re) OVER d, 0)) * (pr + coalesce(lag(pr) OVER d, 1)) / 2 AS area FROM r WINDOW d AS (PARTITION BY series_id, instance ORDER BY score DESC))
SELECT series_id, instance, round(sum(area), 6) AS pr_auc FROM a GROUP BY 1, 2""")
def e11_pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_auc(v.user_scores(spark, sf_dir), [*S, "instance"]).withColumn("pr_auc", R6(F.col("pr_auc")))


@query(f"""{SC}, p AS (SELECT series_id, instance, avg(score) AS m, stddev_pop(score) AS d FROM scores GROUP BY 1, 2),
z AS (SELECT s.series_id, s.instance, s.t, round(m + d, 6) AS back FROM scores s JOIN p USING (series_id, instance) WHERE d > 0) SELECT * FROM z""")
def n2c_gaussian_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One deviation above the mean is erf(1 / sqrt 2); its inverse is mean + deviation."""
    w = Window.partitionBy(*S, "instance")
    s = v.user_scores(spark, sf_dir).withColumns({"m": F.avg("score").over(w), "d": F.stddev_pop("score").over(w)}).where("d > 0")
    back = scores.gaussian_inverse(scalar.erf(F.lit(0.5**0.5)), F.col("m"), F.col("d"))
    return s.select(*S, "instance", "t", R6(back).alias("back"))


@query(f"""SELECT r.*, p.pr_auc, c.accuracy, c.precision, c.recall, c.f1 FROM ({registry.ORACLES["e11_roc_auc"]}) r LEFT JOIN ({registry.ORACLES["e11_pr_auc"]}) p USING (series_id, instance) JOIN ({registry.ORACLES["e9_confusion"]}) c USING (series_id, instance)""")
def e13_individual_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC and PR areas and the confusion of every instance on its own, two-deviation predictions."""
    p = _predicted(spark, sf_dir)
    keys = [*S, "instance"]
    every = metrics.roc_auc(p, keys).join(metrics.pr_auc(p, keys), keys, "left").join(metrics.confusion(p, keys), keys).withColumnRenamed("f_beta", "f1")
    return every.select(*keys, *[R6(F.col(c)).alias(c) for c in ("roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1")])


@query()
def e11_range_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.range_metrics(_predicted(spark, sf_dir), [*S, "instance"])


RANGE_AREAS = """n AS (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE is_anomaly) AS positives FROM ts GROUP BY 1),
edge AS (SELECT series_id, t, is_anomaly AS y, row_number() OVER (PARTITION BY series_id ORDER BY t) - row_number() OVER (PARTITION BY series_id, is_anomaly ORDER BY t) AS island FROM ts),
ranges AS (SELECT series_id, min(t) AS b, max(t) + 1 AS e FROM edge WHERE y GROUP BY series_id, island),
soft AS (SELECT ts.series_id, ts.t, coalesce(max(CASE WHEN greatest(0, b - ts.t, ts.t - e + 1) <= 50 THEN sqrt(1 - greatest(0, b - ts.t, ts.t - e + 1) / 100.0::DOUBLE) END), 0) AS soft FROM ts LEFT JOIN ranges USING (series_id) GROUP BY 1, 2),
total AS (SELECT series_id, n, (positives + sum(soft)) / 2 AS positive FROM soft JOIN n USING (series_id) GROUP BY series_id, n, positives),
ord AS (SELECT s.series_id, s.instance, s.score, soft, row_number() OVER (PARTITION BY s.series_id, s.instance ORDER BY s.score DESC, s.t) - 1 AS place FROM scores s JOIN soft USING (series_id, t)),
th AS (SELECT DISTINCT o.series_id, o.instance, o.score AS th FROM ord o JOIN n USING (series_id) WHERE EXISTS (SELECT 1 FROM range(250) AS r(i) WHERE CASE WHEN i = 249 THEN n - 1 ELSE floor(i * ((n - 1) / 249.0::DOUBLE))::BIGINT END = place)),
cum AS (SELECT th.series_id, th.instance, th, count(*) AS k, sum(soft) AS tp FROM th JOIN ord o ON o.series_id = th.series_id AND o.instance = th.instance AND o.score >= th GROUP BY 1, 2, 3),
tops AS (SELECT r.series_id, r.b, s.instance, max(s.score) AS top FROM ranges r JOIN scores s ON s.series_id = r.series_id AND s.t >= r.b - 50 AND s.t < r.e + 50 GROUP BY 1, 2, 3),
seen AS (SELECT th.series_id, th.instance, th, avg((top >= th)::INT) AS seen FROM th JOIN tops USING (series_id, instance) GROUP BY 1, 2, 3),
curve AS (SELECT c.series_id, c.instance, c.th, least(tp / positive, 1) * seen AS t, greatest(0, least(1, (k - tp) / (n - positive))) AS f, tp / k AS p FROM cum c JOIN seen USING (series_id, instance, th) JOIN total USING (series_id) WHERE positive < n),
step AS (SELECT *, coalesce(lag(t) OVER w, 0) AS t0, coalesce(lag(f) OVER w, 0) AS f0, row_number() OVER (PARTITION BY series_id, instance ORDER BY th) = 1 AS last FROM curve WINDOW w AS (PARTITION BY series_id, instance ORDER BY th DESC))
SELECT series_id, instance, round(sum((t - t0) * p), 6) AS pr, round(sum((f - f0) * (t + t0) / 2) + sum(CASE WHEN last THEN (1 - f) * (1 + t) / 2 ELSE 0 END), 6) AS roc FROM step GROUP BY 1, 2"""


@query(f"{SC},\n{RANGE_AREAS}")
def e11_range_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default quality of the search, and its ROC twin, where a series has anomalies and normal points."""
    found = metrics.range_metrics(_predicted(spark, sf_dir), [*S, "instance"], ["RangePrAUC", "RangeRocAUC"]).where(~F.isnan("value"))
    wide = found.groupBy(*S, "instance").pivot("metric", ["RangePrAUC", "RangeRocAUC"]).agg(F.first("value"))
    return wide.select(*S, "instance", R6(F.col("RangePrAUC")).alias("pr"), R6(F.col("RangeRocAUC")).alias("roc"))


TOP_RANGES = """k AS (SELECT series_id, count(*) AS k FROM islands GROUP BY 1),
pr AS (SELECT *, lag(score) OVER (PARTITION BY series_id, instance ORDER BY t) AS prev FROM scores),
st AS (SELECT series_id, instance, score AS th, 1 AS d FROM pr UNION ALL SELECT series_id, instance, least(score, prev), -1 FROM pr WHERE prev IS NOT NULL),
per AS (SELECT series_id, instance, th, sum(d) AS d FROM st GROUP BY 1, 2, 3),
run AS (SELECT *, sum(d) OVER (PARTITION BY series_id, instance ORDER BY th DESC ROWS UNBOUNDED PRECEDING) AS n FROM per),
k10 AS (SELECT series_id, instance, coalesce(max(CASE WHEN n >= k THEN th END), min(th)) AS threshold FROM run JOIN k USING (series_id) GROUP BY 1, 2)"""


@query(f"{SC},\n{ISLANDS}, {TOP_RANGES} SELECT * FROM k10")
def k10_top_k_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _islands(spark, sf_dir).groupBy(*S).agg(F.count(F.lit(1)).alias("k"))
    s = v.user_scores(spark, sf_dir)
    per_instance = s.select(*S, "instance").distinct().join(k, S)
    return scores.top_k_ranges(s, [*S, "instance"], per_instance)


@query(f"""{SC},\n{ISLANDS}, {TOP_RANGES}, any_p AS (SELECT series_id, t, bool_or(score >= threshold) AS p FROM scores JOIN k10 USING (series_id, instance) GROUP BY 1, 2),
hit AS (SELECT i.series_id, i.b, bool_or(a.p) AS h FROM islands i LEFT JOIN any_p a ON a.series_id = i.series_id AND a.p AND a.t >= greatest(i.b - 2, 0) AND a.t < i.e + 2 GROUP BY 1, 2)
SELECT series_id, round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END), 6) AS hit_percentage FROM hit GROUP BY 1""")
def e7_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions at each instance's top-k-ranges threshold, joined by or, against the labelled ranges."""
    s = v.user_scores(spark, sf_dir)
    th = k10_top_k_ranges(spark, sf_dir)
    flagged = s.join(th, [*S, "instance"]).withColumn("predicted", F.col("score") >= F.col("threshold"))
    points = flagged.groupBy(*S, "t").agg(F.bool_or("predicted").alias("predicted"), F.bool_or("is_anomaly").alias("is_anomaly"))
    return metrics.hit_percentage(points, S, 2).withColumn("hit_percentage", R6(F.col("hit_percentage")))


# ---- distances and selection


PAIRS = "pairs AS (SELECT a.series_id, a.instance AS i, b.instance AS j, a.score AS x, b.score AS y FROM scores a JOIN scores b ON a.series_id = b.series_id AND a.t = b.t AND a.instance < b.instance)"


@query(f"{SC},\n{PAIRS} SELECT series_id, i, j, round(sqrt(sum((x - y) * (x - y))), 5) AS d FROM pairs GROUP BY 1, 2, 3")
def d_a_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.euclidean(v.user_scores(spark, sf_dir), S).withColumn("d", F.round("d", 5))


@query(f"{SC},\n{PAIRS} SELECT series_id, i, j, round(CASE WHEN sum(x * x) * sum(y * y) > 0 THEN 1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)) ELSE 1.0 END, 6) AS d FROM pairs GROUP BY 1, 2, 3")
def d_b_inverse_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.inverse_cosine(v.user_scores(spark, sf_dir), S).withColumn("d", R6(F.col("d")))


OVERLAP = """pp AS (SELECT a.series_id, a.instance AS i, b.instance AS j, a.p::INT AS x, b.p::INT AS y FROM pred a JOIN pred b ON a.series_id = b.series_id AND a.t = b.t AND a.instance < b.instance),
dc AS (SELECT series_id, i, j, CASE WHEN sum(x) = 0 OR sum(y) = 0 THEN 0.0 ELSE 1 - sum(x * y) / sum(greatest(x, y)) END AS d FROM pp GROUP BY 1, 2, 3)"""


@query(f"{SC},\n{PREDICTED},\n{OVERLAP} SELECT series_id, i, j, round(d, 6) AS d FROM dc")
def d_c_annotation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.annotation_overlap(v.user_scores(spark, sf_dir), S).withColumn("d", R6(F.col("d")))


@query(f"{SC},\n{PREDICTED},\n{OVERLAP} SELECT series_id, round(1 - avg(d), 6) AS variety FROM dc GROUP BY 1")
def e2_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variety(distances.annotation_overlap(v.user_scores(spark, sf_dir), S), S).withColumn("variety", R6(F.col("variety")))


@query(f"{SC},\n{PAIRS}, d AS (SELECT series_id, i, j, sqrt(sum((x - y) * (x - y))) AS d FROM pairs GROUP BY 1, 2, 3) SELECT series_id, round(1 - 1 / (1e-10 + avg(d)), 6) AS variety FROM d GROUP BY 1")
def e3_variety_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variety(distances.euclidean(v.user_scores(spark, sf_dir), S), S, "euclidean").withColumn("variety", R6(F.col("variety")))


@query(f"""{SC},\n{MINMAX},\n{PREDICTED},\n{OVERLAP},\n{ISLANDS},\n{RANGES}, q AS (SELECT series_id, avg(best) AS q FROM (SELECT series_id, b, max(score) AS best FROM rs GROUP BY 1, 2) GROUP BY 1),
vv AS (SELECT series_id, 1 - avg(d) AS v FROM dc GROUP BY 1) SELECT series_id, round(CASE WHEN q + v > 0 THEN 2 * q * v / (q + v) ELSE 0.0 END, 6) AS sc_score FROM q JOIN vv USING (series_id)""")
def e8_sc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.quality(_range_scores(spark, sf_dir), S)
    d = metrics.variety(distances.annotation_overlap(v.user_scores(spark, sf_dir), S), S)
    return q.join(d, S).select(*S, R6(metrics.sc_score(F.col("quality"), F.col("variety"))).alias("sc_score"))


CAND = f"WITH {v.CANDIDATES_SQL}"


@query(f"{CAND} SELECT instance, no_datasets, mean_train_quality, row_number() OVER (ORDER BY no_datasets DESC, mean_train_quality DESC, instance) - 1 AS rank FROM candidates")
def sel1_training_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.by_coverage(v.candidates(spark, sf_dir))


@query(f"{CAND} SELECT instance, no_datasets, mean_train_quality, row_number() OVER (ORDER BY mean_train_quality DESC, instance) - 1 AS rank FROM candidates")
def sel2_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.by_quality(v.candidates(spark, sf_dir))


@query(f"""{CAND}, s AS (SELECT *, (no_datasets - min(no_datasets) OVER ()) / (max(no_datasets) OVER () - min(no_datasets) OVER ())::DOUBLE AS a, (mean_train_quality - min(mean_train_quality) OVER ()) / (max(mean_train_quality) OVER () - min(mean_train_quality) OVER ()) AS b FROM candidates)
SELECT instance, no_datasets, mean_train_quality, round((a + b) / 2, 6) AS combined, row_number() OVER (ORDER BY (a + b) / 2 DESC, instance) - 1 AS rank FROM s""")
def sel3_training_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.by_result(v.candidates(spark, sf_dir)).withColumn("combined", R6(F.col("combined")))


@query(f"{CAND} SELECT instance, no_datasets, mean_train_quality FROM candidates ORDER BY mean_train_quality DESC, instance LIMIT 3")
def k1_top_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_k(selection.by_quality(v.candidates(spark, sf_dir)), 3).drop("rank")


def _selected(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = scores.minmax(v.user_scores(spark, sf_dir), S)
        names = selection.select_instances(v.candidates(spark, sf_dir), s, S, method, 3)
        return spark.createDataFrame(list(enumerate(names)), "rank bigint, instance string")

    return run


for _n, _m in enumerate(selection.SELECTIONS, 1):
    if _n > 3:
        _f = _selected(_m)
        _f.__name__ = f"sel{_n}_{_m.replace('-', '_')}"
        query()(_f)


# ---- ranks

VOTES = f"WITH {v.VOTERS_SQL}"
G = ["g"]


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.voters(spark, sf_dir)


@query(f"""{SC}, r AS (SELECT series_id, instance, t, count(*) OVER (PARTITION BY series_id, instance ORDER BY score RANGE UNBOUNDED PRECEDING) AS r FROM scores)
SELECT series_id, instance, t, max(r) OVER (PARTITION BY series_id) - r + 1 AS rank FROM r""")
def w7_max_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.max_ranks(v.user_scores(spark, sf_dir), [*S, "instance"], S).select(*S, "instance", "t", "rank")


BORDA = "borda AS (SELECT g, item, sum(rank)::BIGINT AS points, row_number() OVER (PARTITION BY g ORDER BY sum(rank), item) - 1 AS rank FROM votes GROUP BY 1, 2)"


@query(f"{VOTES},\n{BORDA} SELECT * FROM borda")
def r1_borda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.borda(_votes(spark, sf_dir), G)


@query(f"""{VOTES}, s AS (SELECT g, item, avg(least(rank, 2)) AS points, bool_or(rank < 2) AS seen FROM votes GROUP BY 1, 2)
SELECT g, item, round(points, 6) AS points, CASE WHEN seen THEN row_number() OVER (PARTITION BY g ORDER BY points, item) - 1 ELSE count(*) OVER (PARTITION BY g) - 1 END AS rank FROM s""")
def r2_partial_borda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.partial_borda(_votes(spark, sf_dir), G, 2).withColumn("points", R6(F.col("points")))


KENDALL = """kt AS (SELECT a.g, a.voter, sum((a.rank < b.rank AND x.rank > y.rank)::INT)::BIGINT AS distance FROM votes a JOIN votes b ON a.voter = b.voter
  JOIN borda x ON x.g = a.g AND x.item = a.item JOIN borda y ON y.g = b.g AND y.item = b.item GROUP BY 1, 2)"""


@query(f"{VOTES},\n{BORDA},\n{KENDALL} SELECT * FROM kt")
def r3_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)
    return ranks.kendall(votes, ranks.borda(votes, G), [*G, "voter"], G)


@query(f"{VOTES},\n{BORDA},\n{KENDALL} SELECT g, round(avg(distance), 6) AS objective FROM kt GROUP BY 1")
def r4_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)
    return ranks.objective(votes, ranks.borda(votes, G), G).withColumn("objective", R6(F.col("objective")))


INFLUENCE = f"""{BORDA},\n{KENDALL}, whole AS (SELECT g, avg(distance) AS objective FROM kt GROUP BY 1),
lo AS (SELECT o.g, o.voter AS left_out, v.voter, v.item, v.rank FROM (SELECT DISTINCT g, voter FROM votes) o JOIN votes v ON v.g = o.g AND v.voter <> o.voter),
lb AS (SELECT g, left_out, item, row_number() OVER (PARTITION BY g, left_out ORDER BY sum(rank), item) - 1 AS rank FROM lo GROUP BY 1, 2, 3),
lk AS (SELECT a.g, a.left_out, a.voter, sum((a.rank < b.rank AND x.rank > y.rank)::INT) AS distance FROM lo a JOIN lo b ON a.left_out = b.left_out AND a.voter = b.voter AND a.g = b.g
  JOIN lb x ON x.g = a.g AND x.left_out = a.left_out AND x.item = a.item JOIN lb y ON y.g = b.g AND y.left_out = b.left_out AND y.item = b.item GROUP BY 1, 2, 3),
reliability AS (SELECT w.g, l.left_out AS voter, round(-(w.objective - avg(l.distance)), 6) AS reliability FROM lk l JOIN whole w ON w.g = l.g GROUP BY w.g, w.objective, l.left_out)"""


@query(f"{VOTES},\n{INFLUENCE} SELECT * FROM reliability")
def r5_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.influence(_votes(spark, sf_dir), G).withColumn("reliability", R6(F.col("reliability")))


@query()
def r6_minimum_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.minimum_influence(_votes(spark, sf_dir), G)


VD = """vd AS (SELECT a.g, a.voter, c.voter AS other, sum((a.rank < b.rank AND c.rank > d.rank)::INT)::BIGINT AS distance FROM votes a JOIN votes b ON a.voter = b.voter
  JOIN votes c ON c.g = a.g AND c.item = a.item AND c.voter <> a.voter JOIN votes d ON d.voter = c.voter AND d.item = b.item GROUP BY 1, 2, 3)"""


@query(f"""{VOTES},\n{VD}, n AS (SELECT *, row_number() OVER (PARTITION BY g, voter ORDER BY distance, other) AS rn FROM vd)
SELECT g, voter, round(avg(distance), 6) AS near FROM n WHERE rn <= 3 GROUP BY 1, 2""")
def r7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ranks.proximity(_votes(spark, sf_dir), G)
    return p.select(*G, "voter", R6(F.when(F.col("reliability") > 1e11, 0.0).otherwise(1 / F.col("reliability"))).alias("near"))


@query(f"{VOTES},\n{VD} SELECT g, voter, round(1 / (1e-6 + sum(distance)::DOUBLE / (count(*) + 1)), 5) AS reliability FROM vd GROUP BY 1, 2")
def r8_average_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.average_distance(_votes(spark, sf_dir), G).withColumn("reliability", F.round("reliability", 5))


@query(f"""{VOTES},\n{VD}, rel AS (SELECT g, voter, 1 / (1e-6 + sum(distance)::DOUBLE / (count(*) + 1)) AS r FROM vd GROUP BY 1, 2),
gaps AS (SELECT *, lead(r) OVER w - r AS gap, row_number() OVER w AS n FROM rel WINDOW w AS (PARTITION BY g ORDER BY r, voter)),
split AS (SELECT g, n AS s FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY gap DESC, n) AS k FROM gaps WHERE gap IS NOT NULL) WHERE k = 1),
sided AS (SELECT gaps.*, n > coalesce(s, 0) AS high FROM gaps LEFT JOIN split USING (g)),
sums AS (SELECT g, sum(CASE WHEN high THEN r ELSE 0 END) AS up, sum(CASE WHEN high THEN 0 ELSE r END) AS down FROM sided GROUP BY 1)
SELECT g, voter FROM sided JOIN sums USING (g) WHERE high = (up >= down)""")
def r9_trimmed_voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.trimmed_voters(ranks.average_distance(_votes(spark, sf_dir), G), G)


@query()
def r10_trimmed_borda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.trimmed_borda(_votes(spark, sf_dir), G, "averagedistance", k=3)


@query(f"""{VOTES}, l AS (SELECT a.g, a.item, sum((a.rank > b.rank)::INT)::BIGINT AS points FROM votes a JOIN votes b ON a.voter = b.voter GROUP BY 1, 2)
SELECT g, item, points, row_number() OVER (PARTITION BY g ORDER BY points, item) - 1 AS rank FROM l""")
def r11_kemeny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.kemeny(_votes(spark, sf_dir), G)


@query()
def r12_kemeny_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.kemeny_best(_votes(spark, sf_dir), G)


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).withColumn("rank", F.col("rank") + 1)


_TERMS = " ".join(f"WHEN {k} THEN " + " + ".join(f"{c}.0 * power(r, {j}) * power(1 - r, {5 - j})" for j, c in ((0, 1), (1, 5), (2, 10), (3, 10), (4, 5)) if j >= k) for k in range(5))


@query(f"""{SC}, n AS (SELECT series_id, CASE instance {' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(v.INSTANCES))} END AS v, t AS item,
  row_number() OVER (PARTITION BY series_id, instance ORDER BY score DESC, t)::DOUBLE / count(*) OVER (PARTITION BY series_id, instance) AS r FROM scores)
SELECT series_id, item, round(min(CASE v {_TERMS} END), 5) AS rho FROM n GROUP BY 1, 2""")
def r13_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors vote on the points of each series."""
    s = v.user_scores(spark, sf_dir)
    voter = F.array_position(F.lit(list(v.INSTANCES)), F.col("instance")) - 1
    place = F.row_number().over(Window.partitionBy(*S, "instance").orderBy(F.col("score").desc(), "t"))
    found = ranks.robust(s.select(*S, voter.alias("voter"), F.col("t").alias("item"), place.cast("long").alias("rank")), S, len(v.INSTANCES))
    return found.select(*S, "item", F.round("rho", 5).alias("rho"))


@query(f"""{VOTES}, m AS (SELECT g, item, round(avg(1.0 / (rank + 1)), 6) AS points FROM votes GROUP BY 1, 2)
SELECT g, item, points, count(*) OVER (PARTITION BY g ORDER BY points DESC RANGE UNBOUNDED PRECEDING) AS rank FROM m""")
def r15_inverse_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranks.inverse_ranking(_few(spark, sf_dir), G).withColumn("points", R6(F.col("points")))
    behind = F.count(F.lit(1)).over(Window.partitionBy("g").orderBy(F.col("points").desc()).rangeBetween(Window.unboundedPreceding, 0))
    return found.select("g", "item", "points", behind.alias("rank"))


@query(f"{VOTES} SELECT g, voter, item, round(exp(-(rank + 1) / 10.0), 9) AS phi, round((rank + 1) / 10.0, 9)::DOUBLE AS theta FROM votes")
def r17_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi = _votes(spark, sf_dir).select("g", "voter", "item", ranks.theta_to_phi((F.col("rank") + 1) / F.lit(10.0)).alias("phi"))
    return phi.select("g", "voter", "item", F.round("phi", 9).alias("phi"), F.round(ranks.phi_to_theta(F.col("phi")), 9).alias("theta"))
