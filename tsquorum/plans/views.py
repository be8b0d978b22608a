"""Series, scores, candidates and a result store derived from the driver's tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES = ["series_id"]
MOVING = (5, 13, 25)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a labelled series: (series_id, t, value, is_anomaly)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), (F.row_number().over(order) - 1).cast("long").alias("t"), "value", (F.col("event_type") == "error").alias("is_anomaly"))


SERIES_SQL = """ts AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, event_type = 'error' AS is_anomaly
  FROM events)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One longer series: values by hour since the first, missing hours 0; the busiest tenth of hours is anomalous."""
    events = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    per_hour = events.groupBy(hour.alias("h")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    span = per_hour.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    hours = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    filled = hours.join(per_hour, "h", "left").select(F.lit(0).cast("long").alias("series_id"), (F.col("h") - F.col("lo")).alias("t"), F.round(F.coalesce("value", F.lit(0.0)), 6).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("n").desc(), "t"))
    return filled.withColumn("is_anomaly", place * 10 <= F.count(F.lit(1)).over(Window.partitionBy("series_id"))).select("series_id", "t", "value", "is_anomaly")


HOURLY_SQL = """per_hour AS (
  SELECT epoch(ts)::BIGINT // 3600 AS h, sum(value) AS value, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS ts, value FROM events) GROUP BY 1),
hours AS (SELECT unnest(generate_series((SELECT min(h) FROM per_hour), (SELECT max(h) FROM per_hour))) AS h),
filled AS (
  SELECT 0::BIGINT AS series_id, hours.h - (SELECT min(h) FROM per_hour) AS t, round(coalesce(value, 0.0), 6) AS value, coalesce(n, 0) AS n
  FROM hours LEFT JOIN per_hour USING (h)),
ts AS (
  SELECT series_id, t, value, row_number() OVER (ORDER BY n DESC, t) * 10 <= count(*) OVER () AS is_anomaly FROM filled)"""


def features(points: DataFrame) -> DataFrame:
    """Five cheap detectors side by side, their scores rounded to 6 digits."""
    whole = Window.partitionBy("series_id")
    order = whole.orderBy("t")
    columns = {
        "zscore": F.abs(F.col("value") - F.avg("value").over(whole)) / F.greatest(F.stddev_pop("value").over(whole), F.lit(1e-12)),
        "diff": F.abs(F.col("value") - F.coalesce(F.lag("value").over(order), F.col("value"))),
    }
    for w in MOVING:
        columns[f"ma{w:02d}"] = F.abs(F.col("value") - F.avg("value").over(order.rowsBetween(-(w // 2), w // 2)))
    return points.select("series_id", "t", "value", "is_anomaly", *[F.round(c, 6).alias(n) for n, c in columns.items()])


INSTANCES = ("zscore", "diff", *(f"ma{w:02d}" for w in MOVING))
FEATURES_SQL = """feats AS (
  SELECT series_id, t, value, is_anomaly,
    round(abs(value - avg(value) OVER (PARTITION BY series_id)) / greatest(stddev_pop(value) OVER (PARTITION BY series_id), 1e-12), 6) AS zscore,
    round(abs(value - coalesce(lag(value) OVER (PARTITION BY series_id ORDER BY t), value)), 6) AS diff,
    """ + ",\n    ".join(f"round(abs(value - avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)), 6) AS ma{w:02d}" for w in MOVING) + "\n  FROM ts)"  # fmt: skip


def scores(points: DataFrame) -> DataFrame:
    """The detectors' scores, long: (series_id, instance, t, score, is_anomaly)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("instance"), F.col(n).alias("score")) for n in INSTANCES])
    return features(points).select("series_id", "t", "is_anomaly", F.explode(pairs).alias("p")).select("series_id", "p.instance", "t", "p.score", "is_anomaly")


SCORES_SQL = FEATURES_SQL + ",\nscores AS (\n  " + "\n  UNION ALL ".join(f"SELECT series_id, '{n}' AS instance, t, {n} AS score, is_anomaly FROM feats" for n in INSTANCES) + ")"


def user_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(series(spark, sf_dir))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, instance, quality): how much higher the mean score of anomalous points is, scaled to [0, 1]."""
    s = user_scores(spark, sf_dir).groupBy("series_id", "instance").agg(
        F.avg(F.when(F.col("is_anomaly"), F.col("score"))).alias("hot"), F.avg(F.when(~F.col("is_anomaly"), F.col("score"))).alias("cold"))
    return s.where("hot is not null and cold is not null and hot + cold > 0").select("series_id", "instance", F.round(F.col("hot") / (F.col("hot") + F.col("cold")), 6).alias("quality"))


QUALITY_SQL = SERIES_SQL + ",\n" + SCORES_SQL + """,
q0 AS (SELECT series_id, instance, avg(score) FILTER (WHERE is_anomaly) AS hot, avg(score) FILTER (WHERE NOT is_anomaly) AS cold FROM scores GROUP BY 1, 2),
quality AS (SELECT series_id, instance, round(hot / (hot + cold), 6) AS quality FROM q0 WHERE hot IS NOT NULL AND cold IS NOT NULL AND hot + cold > 0)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance, no_datasets, mean_train_quality): where an instance is best, and its mean quality."""
    q = quality(spark, sf_dir)
    best = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("quality").desc(), "instance")) == 1
    return q.withColumn("_b", best).groupBy("instance").agg(F.sum(F.col("_b").cast("long")).alias("no_datasets"), F.round(F.avg("quality"), 6).alias("mean_train_quality"))


CANDIDATES_SQL = QUALITY_SQL + """,
c0 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY quality DESC, instance) = 1 AS best FROM quality),
candidates AS (SELECT instance, sum(best::INT)::BIGINT AS no_datasets, round(avg(quality), 6) AS mean_train_quality FROM c0 GROUP BY 1)"""


def voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series as voters over instances: (g, voter, item, rank), ranks from 0 by falling quality; only complete ones."""
    q = quality(spark, sf_dir)
    w = Window.partitionBy("series_id")
    full = q.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == len(INSTANCES))
    rank = F.row_number().over(w.orderBy(F.col("quality").desc(), "instance")) - 1
    return full.select((F.col("series_id") % 10).alias("g"), F.col("series_id").alias("voter"), F.col("instance").alias("item"), rank.cast("long").alias("rank"))


VOTERS_SQL = QUALITY_SQL + f""",
v0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM quality),
votes AS (SELECT series_id % 10 AS g, series_id AS voter, instance AS item, row_number() OVER (PARTITION BY series_id ORDER BY quality DESC, instance) - 1 AS rank FROM v0 WHERE n = {len(INSTANCES)})"""


# ------------------------------------------------------------------------------------------ result store

STORE_SQL = """dataset AS (
  SELECT c_custkey::VARCHAR AS hexhash, c_name AS name, n_name AS collection, c_acctbal >= 0 AS paper, c_mktsegment = 'BUILDING' AS revision
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
execution AS (
  SELECT o_orderkey AS id, o_custkey::VARCHAR AS dataset_id, o_orderkey % 4 AS config_id, o_orderkey % 10 AS experiment_id, o_orderstatus AS version,
    o_orderpriority AS ranking_method, CASE WHEN o_orderkey % 2 = 0 THEN 'minmax' ELSE 'gaussian' END AS normalization_method,
    CASE o_orderkey % 3 WHEN 0 THEN 'max' WHEN 1 THEN 'mean' ELSE 'custom' END AS aggregation_method, o_orderkey AS algorithm_ranking_id,
    round(o_totalprice / 100, 6) AS runtime, (o_orderkey * 7919 % 1000) / 1000.0 AS range_pr_auc
  FROM orders),
baseline AS (
  SELECT o_orderkey AS id, o_custkey::VARCHAR AS dataset_id, CASE o_orderkey % 3 WHEN 0 THEN 'best-algo' WHEN 1 THEN 'mean-algo' ELSE 'select-horizontal' END AS name,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS algorithm_ranking_id, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey * 10 + 1 END AS algorithm_scoring_id,
    round(o_totalprice / 200, 6) AS runtime, (o_orderkey * 104729 % 1000) / 1000.0 AS range_pr_auc
  FROM orders WHERE o_orderstatus = 'F'),
scoring AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS ranking_id, (l_linenumber - 1)::BIGINT AS rank, l_orderkey % 10 AS experiment_id, 'algo' || (l_suppkey % 8) AS algorithm,
    l_partkey % 1000 AS window_size, round(l_discount * 10, 6) AS range_pr_auc, l_quantity AS runtime
  FROM lineitem),
trace AS (
  SELECT event_id AS position, user_id % 10 AS experiment_id, user_id AS run, event_type AS trace_name, CASE WHEN event_id % 2 = 0 THEN 'START' ELSE 'END' END AS trace_type,
    (value * 1000)::BIGINT AS duration_ns, props
  FROM events)"""


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stand-ins for the tables of the result store, from orders, lines, customers and events."""
    t = lambda name: table(spark, sf_dir, name)
    k = F.col("o_orderkey")
    orders = t("orders")
    return {
        "dataset": t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").cast("string").alias("hexhash"), F.col("c_name").alias("name"), F.col("n_name").alias("collection"), (F.col("c_acctbal") >= 0).alias("paper"), (F.col("c_mktsegment") == "BUILDING").alias("revision")),
        "execution": orders.select(
            k.alias("id"), F.col("o_custkey").cast("string").alias("dataset_id"), (k % 4).alias("config_id"), (k % 10).alias("experiment_id"), F.col("o_orderstatus").alias("version"), F.col("o_orderpriority").alias("ranking_method"),
            F.when(k % 2 == 0, "minmax").otherwise("gaussian").alias("normalization_method"), F.when(k % 3 == 0, "max").when(k % 3 == 1, "mean").otherwise("custom").alias("aggregation_method"),
            k.alias("algorithm_ranking_id"), F.round(F.col("o_totalprice") / 100, 6).alias("runtime"), (k * 7919 % 1000 / 1000.0).alias("range_pr_auc")),
        "baseline": orders.where("o_orderstatus = 'F'").select(
            k.alias("id"), F.col("o_custkey").cast("string").alias("dataset_id"), F.when(k % 3 == 0, "best-algo").when(k % 3 == 1, "mean-algo").otherwise("select-horizontal").alias("name"),
            F.when(k % 2 == 0, k).alias("algorithm_ranking_id"), F.when(k % 2 == 1, k * 10 + 1).alias("algorithm_scoring_id"), F.round(F.col("o_totalprice") / 200, 6).alias("runtime"), (k * 104729 % 1000 / 1000.0).alias("range_pr_auc")),
        "scoring": t("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("ranking_id"), (F.col("l_linenumber") - 1).cast("long").alias("rank"), (F.col("l_orderkey") % 10).alias("experiment_id"),
            F.concat(F.lit("algo"), (F.col("l_suppkey") % 8).cast("string")).alias("algorithm"), (F.col("l_partkey") % 1000).alias("window_size"), F.round(F.col("l_discount") * 10, 6).alias("range_pr_auc"), F.col("l_quantity").alias("runtime")),
        "trace": t("events").select(
            F.col("event_id").alias("position"), (F.col("user_id") % 10).alias("experiment_id"), F.col("user_id").alias("run"), F.col("event_type").alias("trace_name"), F.when(F.col("event_id") % 2 == 0, "START").otherwise("END").alias("trace_type"),
            F.round(F.col("value") * 1000).cast("long").alias("duration_ns"), "props"),
    }
