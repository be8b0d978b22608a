"""A database's catalogue is held against the store's tables; the checked limits of what passes through the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tsquorum.operators import detectors, generation, selection
from tsquorum.sources import schemas
from tsquorum.sources.store import KEYS, reflect

KIND = {"string": "VARCHAR(200)", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def test_a_missing_column_is_named(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)

    def make(name: str, left_out: tuple = (), kinds: dict | None = None, key: bool = True) -> None:
        columns = [p.split() for p in schemas.STORE[name].split(", ") if p.split()[0] not in left_out]
        typed = [f'"{c.upper()}" {(kinds or {}).get(c, KIND[k])}' + " NOT NULL" * (c in KEYS[name]) for c, k in columns]
        if key and KEYS[name]:
            typed.append("PRIMARY KEY (" + ", ".join(f'"{c.upper()}"' for c in KEYS[name]) + ")")
        statement = connection.createStatement()
        statement.execute(f'CREATE TABLE "{name.upper()}" ({", ".join(typed)})')
        statement.close()

    odd = {"dataset": {"left_out": ("paper",)}, "scoring": {"kinds": {"score": "VARCHAR(20)"}}, "execution": {"key": False}}
    for name in schemas.STORE:
        if name != "cleaning_metrics":
            make(name, **odd.get(name, {}))
    assert reflect(spark, url, driver=driver) == [
        "dataset: no column paper", "scoring: column score is string, not double", "execution: its primary key is (), not (id)", "cleaning_metrics: no such table"]
    statement = connection.createStatement()
    for sql in ('ALTER TABLE "DATASET" ADD COLUMN "PAPER" BOOLEAN', 'DROP TABLE "SCORING"', 'DROP TABLE "EXECUTION"'):
        statement.execute(sql)
    for name in ("scoring", "execution", "cleaning_metrics"):
        make(name)
    assert reflect(spark, url, driver=driver) == []
    connection.close()


def test_limits_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(generation, "MOST_PAIRS", 2)
    pairs = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.0), (1, 2, 0.0)], "i int, j int, d double")
    with pytest.raises(ValueError, match="pairs of base series"):
        generation.prune_similar(pairs, dict.fromkeys(range(3), 10), dict.fromkeys(range(3), 5))
    monkeypatch.setattr(detectors, "MOST_JOBS", 1)
    jobs = spark.createDataFrame([("a", "knn", "{}"), ("b", "knn", "{}")], "instance string, algorithm string, params_json string")
    with pytest.raises(ValueError, match="settings"):
        detectors.run_detectors(spark.createDataFrame([], "series_id int, t bigint, value double"), jobs, ["series_id"])
    many = spark.range(selection.MOST_CANDIDATES + 1).select(F.col("id").cast("string").alias("instance"), F.lit(1).alias("no_datasets"), F.lit(0.5).alias("mean_train_quality"))
    with pytest.raises(ValueError, match="candidates"):
        selection.Matrix(many, pairs.withColumns({"i": F.col("i").cast("string"), "j": F.col("j").cast("string")}))


def test_a_registered_detector_runs_in_the_workers(spark):
    detectors.register("steps", detectors.Detector(lambda x, p, rng: abs(x - x.mean()) * p["by"], {"by": 2}))
    try:
        points = spark.createDataFrame([(1, t, float(t % 5)) for t in range(20)], "series_id int, t bigint, value double")
        jobs = spark.createDataFrame([("s", "steps", '{"by": 3}')], "instance string, algorithm string, params_json string")
        got = [r["score"] for r in detectors.run_detectors(points, jobs, ["series_id"]).orderBy("t").collect()]
        assert got == [abs(t % 5 - 2.0) * 3 for t in range(20)]
    finally:
        del detectors.DETECTORS["steps"]
