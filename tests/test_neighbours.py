"""Neighbours over many tasks equal the kernels of one task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsquorum.operators import detectors, neighbours
from tsquorum.plans import kernel_queries, registry, views  # noqa: F401

S = ["series_id"]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    long = np.sin(np.arange(400) / 7) + 0.2 * rng.standard_normal(400)
    long[100:140] = 0.5  # constant windows
    return {1: long, 2: rng.standard_normal(57), 3: np.array([1.0, 2.0, 1.5, 1.0]), 4: np.array([3.0]), 5: np.zeros(30)}


@pytest.fixture(scope="module")
def points(spark, series):
    return spark.createDataFrame([(s, t, float(x)) for s, values in series.items() for t, x in enumerate(values)], "series_id int, t bigint, value double").repartition(3)


def by_series(frame):
    out: dict = {}
    for r in frame.orderBy("series_id", "t").collect():
        out.setdefault(r["series_id"], []).append(r["score"])
    return {s: np.array(x) for s, x in out.items()}


@pytest.mark.parametrize("length", [50, 4096])
@pytest.mark.parametrize("method,p", [("largest", 2), ("mean", 2), ("median", 1)])
def test_knn_in_parts_equals_the_kernel(points, series, length, method, p):
    got = by_series(neighbours.knn_scores(points, S, 12, 4, method, p, length))
    for s, values in series.items():
        want = detectors.knn(values, {"window_size": 12, "n_neighbors": 4, "method": method, "p": p}, None)
        assert np.allclose(got[s], want, atol=1e-6), s


@pytest.mark.parametrize("length", [50, 4096])
def test_profile_in_parts_equals_the_kernel(points, series, length):
    got = by_series(neighbours.profile_scores(points, S, 12, length))
    for s, values in series.items():
        assert np.allclose(got[s], detectors.matrix_profile(values, {"window_size": 12}, None), atol=1e-4), s


def test_lof_in_parts_equals_the_kernel(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(300).cumsum()
    points = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(x)], "series_id int, t bigint, value double")
    got = by_series(neighbours.lof_scores(points, S, 9, 7, length=40))
    assert np.allclose(got[1], detectors.lof(x, {"window_size": 9, "n_neighbors": 7}, None), rtol=1e-6)


def test_vectors_in_parts_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(g, i, rng.integers(0, 4, 3).astype(float).tolist()) for g, n in (("a", 90), ("b", 3), ("c", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, id int, vector array<double>")
    got = {(r["g"], r["id"]): (list(r["others"]), list(r["distances"])) for r in neighbours.nearest_vectors(frame, ["g"], 4, length=20).collect()}
    assert len(got) == len(rows)
    for g, i, v in rows:
        near = sorted((float(np.sqrt(((np.array(v) - w) ** 2).sum())), j) for h, j, w in rows if h == g and j != i)[:4]
        others, d = got[g, i]
        assert others == [j for _, j in near] and np.allclose(d, [x for x, _ in near], atol=1e-6)
    last = {(r["g"], r["id"]): r["distance"] for r in detectors.knn_frame(frame, ["g"], 4).collect()}
    assert ("c", 0) not in last and np.isclose(last["b", 0], got["b", 0][1][-1])


def test_no_rows_and_one_point(spark, points):
    none = points.where("false")
    assert neighbours.knn_scores(none, S, 5, 2).collect() == [] == neighbours.nearest_vectors(none.select("series_id", F.col("t").alias("id"), F.array("value").alias("vector")), S, 2).collect()
    alone = points.where("series_id = 4")
    assert [tuple(r) for r in neighbours.profile_scores(alone, S, 5).collect()] == [(4, 0, 0.0)]


def test_query_of_lof_equals_the_kernel(spark, sf_dir):
    x = np.array([r["value"] for r in views.hourly(spark, sf_dir).orderBy("t").collect()])
    got = np.array([r["score"] for r in registry.QUERIES["m1_lof_parts"](spark, sf_dir).orderBy("t").collect()])
    want = detectors.lof(x, {"window_size": 24, "n_neighbors": 20}, None)
    assert got.shape == want.shape and np.allclose(got, want, rtol=1e-3)
