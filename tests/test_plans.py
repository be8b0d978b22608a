"""Sources, store, configuration, the pipeline and the streaming extension."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsquorum.plans import config, pipeline, reports
from tsquorum.sources import files, synthetic
from tsquorum.sources.store import Store, from_jdbc, to_jdbc
from tsquorum.streaming import sigma


def test_series_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,value,is_anomaly\n0,1.5,0\n1,2.5,1.0\n2,-3,0.0\n")
    (tmp_path / "b.csv").write_text("0,7,0\n1,8,1\n")
    got = {(r["name"], r["t"]): (r["value"], r["is_anomaly"]) for r in files.read_series(spark, str(tmp_path)).collect()}
    assert got == {("a", 0): (1.5, False), ("a", 1): (2.5, True), ("a", 2): (-3.0, False), ("b", 0): (7.0, False), ("b", 1): (8.0, True)}
    assert files.content_hash(spark, str(tmp_path / "a.csv")).first()["hexhash"] == files.read_series(spark, str(tmp_path / "a.csv")).first()["series_id"]
    files.write_series(files.read_series(spark, str(tmp_path / "a.csv")), str(tmp_path / "out"))
    assert files.read_series(spark, [str(p) for p in (tmp_path / "out").glob("*/*.csv")]).count() == 3


def test_score_and_result_files(spark, tmp_path):
    (tmp_path / "abc-stomp-12ff.csv").write_text("0.5\nnan\n1.5\n")
    got = files.read_scores(spark, str(tmp_path / "abc-stomp-12ff.csv")).orderBy("t").collect()
    assert [(r["dataset_id"], r["instance"], r["t"]) for r in got] == [("abc", "stomp-12ff", t) for t in range(3)] and got[2]["score"] == 1.5
    r = spark.createDataFrame([("a", {"w": "3", "k": "1"}, "d", 0.5, 1.0)], "algorithm string, params map<string,string>, dataset string, quality double, duration double")
    files.write_results(r, str(tmp_path / "res"))
    assert files.read_results(spark, str(tmp_path / "res")).first()["params"] == {"w": "3", "k": "1"}


def test_store(spark, tmp_path):
    (tmp_path / "x.test.csv").write_text("timestamp,value,label\n0,1,0\n1,2,1\n")
    store = Store(spark, str(tmp_path / "store"))
    store.load_dataset(str(tmp_path / "x.test.csv"), "C", True)
    assert store["dataset"].first()["name"] == "x"
    with pytest.raises(ValueError, match="in the store"):
        store.load_dataset(str(tmp_path / "x.test.csv"), "C")
    h = store["dataset"].first()["hexhash"]
    assert store.load_series(h).count() == 2
    results = spark.createDataFrame([(h, "stomp", {"w": "3"}, 0.5, 1.0)], "dataset_id string, algorithm string, params map<string,string>, quality double, duration double")
    scores = results.select("dataset_id", F.concat_ws("-", "algorithm", F.md5(F.to_json("params"))).alias("instance"), F.lit(0).cast("bigint").alias("t"), F.lit(0.5).alias("score"))
    executions = spark.createDataFrame([(h, "training-result", "minmax", "custom", 1.0)], "dataset_id string, ranking_method string, normalization_method string, aggregation_method string, runtime double")
    trace = spark.createDataFrame([("a-%-b", "END", 1, 2, 1)], "timer string, type string, begin_ns bigint, end_ns bigint, duration_ns bigint")
    n = store.import_backup("2023-01-02-run", "1", "c", "{}", results, scores, scores.select("dataset_id", "instance", F.lit(0).alias("rank")), executions, trace)
    assert store["scoring"].count() == store["execution"].count() == store["algorithm_ranking_entry"].count() == 1
    assert store.import_backup("2023-01-03-run", "1", "c", "{}", results, scores, scores.select("dataset_id", "instance", F.lit(0).alias("rank")), executions, trace) == n + 1
    assert store["algorithm_scoring"].count() == 1 and store["configuration"].count() == 1
    store.delete_experiment(n)
    assert store["experiment"].count() == 1 and store["scoring"].count() == 0 and store["execution"].count() == 1


def test_store_survives_a_broken_replacement(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    store.append("experiment", row)
    (tmp_path / "experiment").rename(tmp_path / ".experiment.old")  # as after a crash between the two renames
    assert store["experiment"].count() == 2 and store.next_id("experiment") == 3
    store.append("experiment", spark.createDataFrame([(3, "c")], "id bigint, name string"))
    assert store["experiment"].count() == 3 and not (tmp_path / ".experiment.old").exists()
    store.delete_experiment(2)
    store.delete_experiment(2)
    assert sorted(r["id"] for r in store["experiment"].collect()) == [1, 3] and not (tmp_path / ".experiment.old").exists()


def test_database_round_trip(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(20).select("id", F.when(F.col("id") < 99, F.concat(F.lit("n"), "id")).alias("name"), (F.col("id") / 2).alias("x"))
    to_jdbc(rows, url, "t", **driver)
    to_jdbc(spark.createDataFrame([(20, None, None)], "id bigint, name string, x double"), url, "t", **driver)
    got = from_jdbc(spark, url, "t", column="id", bounds=(0, 20), partitions=4, **driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 21
    assert sorted(tuple(r) for r in got.where("id < 20").collect()) == sorted(tuple(r) for r in rows.collect())
    assert got.where("name is null").count() == 1


def test_final_order(spark):
    from tsquorum.operators import optimization

    c = spark.createDataFrame([("s", "b", "{}", 0, None), ("s", "a", "{}", 0, 0.2), ("s", "c", "{}", 2, 0.1), ("s", "c", "{1}", 2, 0.5), ("r", "a", "{}", 1, 0.3)], "series_id string, algorithm string, params_json string, no_datasets bigint, mean_train_quality double")
    got = optimization.final_order(c, ["series_id"]).where("series_id = 's'").orderBy("position").collect()
    assert [(r["algorithm"], r["params_json"], r["position"]) for r in got] == [("c", "{1}", 0), ("c", "{}", 1), ("a", "{}", 2), ("b", "{}", 3)]


def test_config():
    c = config.load({"general": {"max_instances": 3}}, {"TSQUORUM__CLEANING__VOTES": "0.5", "HOME": "x"})
    assert c.general.max_instances == 3 and c.cleaning.votes == 0.5
    for bad in ({"general": {"algorithms": ["none"]}}, {"nothing": {}}, {"general": {"nothing": 1}}):
        with pytest.raises(ValueError):
            config.load(bad, {})


def test_reports_filters(spark):
    e = spark.createDataFrame([("a", 1), ("b", 2)], "version string, config_id bigint")
    assert reports.filtered(e, versions=[]).count() == 2 and reports.filtered(e, versions=["a"], config_ids=[1, 2]).count() == 1
    with pytest.raises(ValueError, match="no such filter"):
        reports.filtered(e, nothing=[1])


def test_pipeline_finds_planted_anomalies_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(2):
        x = np.sin(np.arange(700) * 2 * np.pi / 25) + rng.normal(0, 0.05, 700)
        x[400:420] = x[400:420][::-1] * 0.2 + 1
        rows += [(s, t, float(v), 400 <= t < 420) for t, v in enumerate(x)]
    points = spark.createDataFrame(rows, "series_id bigint, t bigint, value double, is_anomaly boolean")
    c = config.load({"general": {"algorithms": ["subsequence_knn", "kmeans"], "max_instances": 2}, "optimization": {"max_trials": 2, "rounds": 1}, "anomaly": {"kinds": ["hmirror", "scale"], "lengths": [20]}, "cleaning": {"reach": 8}}, {})
    out = pipeline.run(points, c, str(tmp_path / "work"))
    got = {s: [] for s in range(2)}
    for r in out.orderBy("t").collect():
        got[r["series_id"]].append(r["score"])
    for s in got.values():
        assert len(s) == 700 and np.mean(s[395:425]) > 3 * np.mean(s)
    assert pipeline.run(points, c, str(tmp_path / "work")).count() == 1400
    scored, found = spark.read.parquet(str(tmp_path / "work/scores")), spark.read.parquet(str(tmp_path / "work/candidates"))
    every = pipeline.all_combinations(points, scored, found, config.load({"scoring": {"normalizations": ["minmax", "gaussian"], "combinations": ["max", "custom"]}}, {}))
    assert every.count() == 8 and pipeline.oracle_choice(every).count() == 2


def test_base_series_cleaned_by_labels(spark):
    rows = [(0, t, float(t), 10 <= t < 20) for t in range(100)] + [(1, t, float(t), True) for t in range(30)] + [(2, 0, 1.0, None)]
    points = spark.createDataFrame(rows, "series_id bigint, t bigint, value double, is_anomaly boolean")
    periods = spark.createDataFrame([(s, 1) for s in range(3)], "series_id bigint, period bigint")
    for limit, want in ((1000, [*range(10), *range(20, 100)]), (85, [*range(5), *range(20, 100)]), (80, [*range(20, 100)]), (30, [*range(20, 50)])):
        c = config.load({"cleaning": {"by_labels": True}, "data_gen": {"least_length": limit}}, {})
        base = pipeline.base_series(points, periods, c).orderBy("series_id", "t").collect()
        assert [(r["series_id"], r["t"], r["value"]) for r in base] == [(0, t, float(x)) for t, x in enumerate(want)] + [(2, 0, 1.0)]
        assert not any(r["is_anomaly"] for r in base)


def test_synthetic_series(spark):
    f = synthetic.frame(spark, (0, 4))
    assert {(r["series_id"], r["n"], r["a"]) for r in f.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("a")).collect()} == {("gt-0", 10_000, 300), ("gt-4", 13_000, 240)}
    parts = spark.createDataFrame([(1, p, t) for p in (0, 1) for t in range(3)], "s int, part int, t bigint")
    assert sorted(r["t"] for r in synthetic.concatenated(parts, ["s"]).collect()) == list(range(6))


def test_streaming_scores_like_the_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "value")
    want = sigma.window_statistics(events, window="10 days").select("user_id", "window", "n").collect()
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = sigma.window_statistics(stream, window="10 days").writeStream.format("memory").queryName("sigma_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("sigma_test").select("user_id", "window", "n").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sigma.suspicious(sigma.window_statistics(events, window="30 days")).count() > 0
