"""Queries and operators on inputs that failed a review: values of 0, many voters, repeated work."""

from __future__ import annotations

import itertools
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tsquorum.operators import batches, detectors, injection, metrics, ranks, selection
from tsquorum.plans import kernel_queries, registry


def events(spark, folder, rows):
    """An events table of (user, value), a minute apart."""
    start = datetime(2024, 1, 1)
    made = [(i, start + timedelta(minutes=i), u, "error" if i % 7 == 0 else "view", float(v), None) for i, (u, v) in enumerate(rows)]
    spark.createDataFrame(made, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def by_sql(name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return sorted(con.execute(registry.ORACLES[name]).fetchall())


def test_choose_k_where_a_block_has_no_area(spark, tmp_path):
    rows = [(1, 0.0 if 10 <= t < 20 else 5.0) for t in range(35)] + [(2, 0.0002 if t == 20 else 3.0) for t in range(21)] + [(3, 9.0 - t // 10) for t in range(40)]
    folder = events(spark, tmp_path, rows)
    found = sorted(map(tuple, kernel_queries.g3_choose_k(spark, folder).collect()))
    assert found == by_sql("g3_choose_k", folder) and found[:2] == [(1, 1), (2, 2)]


def ballots(seed, voters, items, different, missing):
    """Voters with one of some rankings each, with equal ranks and, if ``missing``, without some items."""
    rng = np.random.default_rng(seed)
    kinds = [{f"i{i:02d}": int(r) for i, r in enumerate(rng.integers(0, items, items)) if not missing or rng.random() < 0.7 or i == k % items} for k in range(different)]
    return {v: kinds[int(rng.integers(different))] for v in range(voters)}


def rows_of(spark, groups):
    return spark.createDataFrame([(g, v, i, r) for g, cast in groups.items() for v, one in cast.items() for i, r in one.items()], "g bigint, voter bigint, item string, rank bigint")


def inversions(x, y):
    return sum(x[a] < x[b] and y[a] > y[b] for a in x if a in y for b in x if b in y)


def borda(cast):
    points = {i: sum(one[i] for one in cast.values() if i in one) for one in cast.values() for i in one}
    return {i: n for n, i in enumerate(sorted(points, key=lambda i: (points[i], i)))}


def by_pairs(cast, metric, k=3):
    """Reliabilities voter by voter, from the definitions."""
    rows = {v: sorted(inversions(x, y) for u, y in cast.items() if u != v and set(x) & set(y)) for v, x in cast.items()}
    if metric == "proximity":
        return {v: 1 / max(np.mean(d[:k]), 1e-12) for v, d in rows.items() if d}
    if metric == "averagedistance":
        return {v: 1 / (1e-6 + sum(d) / (len(d) + 1)) for v, d in rows.items() if d}
    fit = lambda some: np.mean([inversions(x, borda(some)) for x in some.values()])
    return {v: fit({u: x for u, x in cast.items() if u != v}) - fit(cast) for v in cast} if len(cast) > 1 else {}


GROUPS = {0: ballots(1, 40, 5, 9, False), 1: ballots(2, 25, 6, 25, True), 2: ballots(3, 2, 4, 2, False), 3: ballots(4, 1, 3, 1, False), 4: ballots(5, 30, 4, 2, True)}


@pytest.mark.parametrize("metric", ["influence", "averagedistance", "proximity"])
def test_reliabilities_are_those_of_all_pairs(spark, metric, monkeypatch):
    monkeypatch.setattr(ranks, "MOST_BALLOTS", 4)  # several parts
    found = ranks.RELIABILITIES[metric](rows_of(spark, GROUPS), ["g"]).collect()
    want = {(g, v): r for g, cast in GROUPS.items() for v, r in by_pairs(cast, metric).items()}
    assert len(found) == len(want) and {(r["g"], r["voter"]): r["reliability"] for r in found} == pytest.approx(want)


def kept(reliability):
    """The side of the largest gap that adds up to more, voter by voter."""
    order = sorted(reliability, key=lambda v: (reliability[v], v))
    gaps = [reliability[b] - reliability[a] for a, b in itertools.pairwise(order)]
    split = gaps.index(max(gaps)) + 1 if gaps else 0
    high, low = order[split:], order[:split]
    return set(high if sum(reliability[v] for v in high) >= sum(reliability[v] for v in low) else low)


def test_trimmed_voters_are_a_side_of_the_largest_gap(spark):
    some = {0: [0.5, 2.0, 2.25, 0.5], 1: [1.0], 2: [1.0, 1.0], 3: [1.0] * 5, 4: [3.0, 1.0, 2.0], 5: [1.0, 1.5, 1.25, 9.0]}
    table = spark.createDataFrame([(g, v, r) for g, rs in some.items() for v, r in enumerate(rs)], "g bigint, voter bigint, reliability double")
    found = {(r["g"], r["voter"]) for r in ranks.trimmed_voters(table, ["g"]).collect()}
    assert found == {(g, v) for g, rs in some.items() for v in kept(dict(enumerate(rs)))}
    left = ranks.trimmed_borda(rows_of(spark, GROUPS), ["g"], "averagedistance").where("g = 1").collect()
    who = kept(by_pairs(GROUPS[1], "averagedistance"))
    assert {r["item"]: r["rank"] for r in left} == borda({v: GROUPS[1][v] for v in who})


def test_the_voter_of_least_influence_is_the_first_of_the_most_reliable(spark):
    found = ranks.minimum_influence(rows_of(spark, GROUPS), ["g"]).select("g", "voter").distinct().collect()
    reliable = {g: by_pairs(cast, "influence") for g, cast in GROUPS.items() if len(cast) > 1}
    assert {r["g"]: r["voter"] for r in found} == {g: min(r, key=lambda v: (-round(r[v], 9), v)) for g, r in reliable.items()}


def most_rows(frame):
    """The rows out of the plan's busiest operator."""
    frame.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if "QueryStageExec" in name:
            return walk(node.plan())
        rows = node.metrics().get("numOutputRows")
        children = node.children()
        return max([rows.get().value() if rows.isDefined() else 0, *[walk(children.apply(i)) for i in range(children.size())]])

    return walk(frame._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("metric", ["influence", "averagedistance", "proximity"])
def test_rows_grow_with_voters_not_their_pairs(spark, metric):
    """300 voters of 5 items, of whom each pair would be 25 rows and more."""
    assert most_rows(ranks.RELIABILITIES[metric](rows_of(spark, {0: ballots(1, 300, 5, 9, False)}), ["g"])) < 300 * 25


def many_series(seed, number):
    """Short and long, constant, rounded, with repeats, NaN, and too short ones."""
    rng = np.random.default_rng(seed)
    made = [np.round(rng.exponential(50, int(rng.integers(4, 140))), int(rng.integers(0, 3))) for _ in range(number)]
    return [*made, np.full(40, 3.0), np.repeat([1.0, 2.0], 20), np.arange(11.0), np.arange(2.0), rng.random(300), np.array([1.0, np.nan, 2.0, 1.0, 5.0])]


@pytest.mark.parametrize("params", [{}, {"n_trees": 7, "window_size": 3}, {"n_trees": 9, "max_samples": 40, "window_size": 5}, {"bootstrap": True, "n_trees": 5}, {"window_size": 1, "n_trees": 5}])
def test_forests_of_many_series_are_those_of_each(params):
    series, params = many_series(1, 25), {"window_size": 10, "n_trees": 30} | params
    for x, found in zip(series, detectors.execute_many(series, detectors.DETECTORS["subsequence_if"], params), strict=True):
        assert np.array_equal(found, detectors.execute(x, "subsequence_if", params), equal_nan=True)


def test_forests_are_made_of_many_series_at_once(spark, monkeypatch):
    """Whatever the batches, the scores are those of each series; those that can't be scored have none."""
    series = many_series(2, 30)
    points = spark.createDataFrame([(s, t, float(v)) for s, x in enumerate(series) for t, v in enumerate(x)], "s int, t bigint, value double").repartition(3)
    jobs = spark.createDataFrame([("a", "subsequence_if", '{"window_size": 10, "n_trees": 10}'), ("b", "subsequence_if", '{"window_size": 4, "n_trees": 3}')], "instance string, algorithm string, params_json string")
    for most in (1, 500, batches.MOST_ROWS):
        monkeypatch.setattr(batches.by_batches, "__defaults__", (most,))
        frame = detectors.run_detectors(points, jobs, ["s"])
        assert "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().executedPlan().toString()
        found = {(r["s"], r["instance"], r["t"]): r["score"] for r in frame.collect()}
        for s, x in enumerate(series):
            for name, params in (("a", {"window_size": 10, "n_trees": 10}), ("b", {"window_size": 4, "n_trees": 3})):
                want = detectors.execute(x, "subsequence_if", params)
                assert [found[s, name, t] for t in range(len(x))] == [None if np.isnan(v) else v for v in want]


def candidates_and_scores(spark):
    rng = np.random.default_rng(4)
    names = [f"i{k}" for k in range(6)]
    known = spark.createDataFrame([(n, int(rng.integers(9)), float(rng.random())) for n in names], "instance string, no_datasets bigint, mean_train_quality double")
    return known, spark.createDataFrame([(s, n, t, float(rng.random())) for s in range(4) for n in names for t in range(20)], "s int, instance string, t bigint, score double")


@pytest.mark.parametrize("method", ["aggregated-minimum-influence", "aggregated-robust-borda"])
def test_aggregated_selections_work_out_distances_once(spark, monkeypatch, method):
    known, scored = candidates_and_scores(spark)
    calls = []
    monkeypatch.setitem(selection.DISTANCES, "euclidean", lambda *a, once=selection.DISTANCES["euclidean"]: calls.append(1) or once(*a))
    names = selection.select_instances(known, scored, ["s"], method, 3)
    votes = selection.rankings(known, scored, ["s"], 3).collect()
    for voter, name in enumerate(selection.AGGREGATED):
        order = selection.SELECTIONS[name](known, scored, ["s"], 3 if "clustering" in name else 6)
        assert sorted((r["rank"], r["item"]) for r in votes if r["voter"] == voter and r["rank"] < 6) == list(enumerate(order))
    assert len(names) == 3 and len(calls) == 2 + 5


def test_candidates_are_worked_out_once(spark):
    known, scored = candidates_and_scores(spark)
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        runs.add(1)
        yield from batches

    selection.select_instances(known.coalesce(1).mapInArrow(counted, known.schema), scored, ["s"], "aggregated-robust-borda", 3)
    assert runs.value == 1


def areas_one_by_one(label, score, buffer, steps=250):
    """(ROC, PR) areas point by point and range by range."""
    n, half = len(label), buffer // 2
    ranges = metrics._ranges(label)
    away = [min([max(0, b - t, t - e + 1) for b, e in ranges], default=n) for t in range(n)]
    soft = np.array([np.sqrt(max(0, 1 - a / max(buffer, 1))) if a <= half else 0.0 for a in away])
    positive = (label.sum() + soft.sum()) / 2
    if not ranges or positive >= n:
        return np.nan, np.nan
    order = sorted(range(n), key=lambda t: -score[t])
    curve = []
    for th in dict.fromkeys(score[order[int(i)]] for i in np.linspace(0, n - 1, steps)):
        high = score >= th
        tp, k = soft[high].sum(), high.sum()
        seen = np.mean([score[max(0, b - half) : e + half].max() >= th for b, e in ranges])
        curve.append((min(tp / positive, 1) * seen, min(max((k - tp) / (n - positive), 0), 1), tp / k))
    t, f, p = ([0.0, *x] for x in zip(*curve, strict=True))
    pr = sum((t[i] - t[i - 1]) * p[i] for i in range(1, len(t)))
    t, f = [*t, 1.0], [*f, 1.0]
    return sum((f[i] - f[i - 1]) * (t[i] + t[i - 1]) / 2 for i in range(1, len(t))), pr


def test_range_areas_of_all_buffers_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    for n, share in ((40, 0.2), (90, 0.1), (30, 1.0), (30, 0.0), (1, 1.0), (60, 0.5)):
        label, score = rng.random(n) < share, np.round(rng.random(n), 1)
        for most in (metrics.MOST_NUMBERS, 50):
            monkeypatch.setattr(metrics, "MOST_NUMBERS", most)
            found = metrics._range_areas(label, score, (0, 1, 7, 30, 100), 250)
            assert found == pytest.approx(np.array([areas_one_by_one(label, score, b) for b in (0, 1, 7, 30, 100)]), nan_ok=True)


def test_range_metrics_come_from_batches_of_series(spark):
    rng = np.random.default_rng(8)
    rows = [(s, t, bool(rng.random() < 0.2 and s), float(rng.random()), bool(rng.random() < 0.2)) for s in range(12) for t in range(int(rng.integers(1, 60)))]
    points = spark.createDataFrame(rows, "s int, t bigint, is_anomaly boolean, score double, predicted boolean")
    frame = metrics.range_metrics(points.repartition(3), ["s"])
    assert "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().executedPlan().toString()
    found = {(r["s"], r["metric"]): r["value"] for r in frame.collect()}
    for s in range(12):
        y, score, p = (np.array([r[c] for r in rows if r[0] == s]) for c in (2, 3, 4))
        for name, (f, continuous) in metrics.METRICS.items():
            want = f(y, score if continuous else p)
            assert found[s, name] == (None if np.isnan(want) else want)


def test_injections_of_many_series_are_those_of_each(spark, monkeypatch):
    rng = np.random.default_rng(9)
    series = [np.round(rng.exponential(9, int(rng.integers(2, 90))), 2) for _ in range(14)] + [np.full(60, 2.0)]
    labels = [rng.random(len(x)) < 0.02 for x in series]
    points = spark.createDataFrame([(s, t, float(v), bool(y[t])) for s, (x, y) in enumerate(zip(series, labels, strict=True)) for t, v in enumerate(x)], "s int, t bigint, value double, is_anomaly boolean")
    plan = injection.injection_plan(points.select("s").distinct().where("s <> 3"), ["s"], list(injection.TRANSFORMS), F.array(F.lit(4), F.lit(8)))
    want = {}
    for s, (x, y) in enumerate(zip(series, labels, strict=True)):
        for kind, length in itertools.product(injection.TRANSFORMS, (4, 8)):
            v, z, _, notes = injection.inject(x, y, np.zeros(0, int), [kind], length, np.random.default_rng(42))
            if notes and s != 3:
                want[s, kind, length] = [(t, a, b, notes if t == 0 else None) for t, (a, b) in enumerate(zip(v.tolist(), z.tolist(), strict=True))]
    for most in (100, batches.MOST_ROWS):
        monkeypatch.setattr(injection, "MOST_ROWS", most)
        frame = injection.inject_all(points.repartition(3), plan, ["s"])
        assert "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().executedPlan().toString()
        found = {}
        for r in sorted(frame.collect(), key=lambda r: r["t"]):
            notes = r["annotations"] and [n.asDict() for n in r["annotations"]]
            found.setdefault((r["s"], r["anomaly_type"], r["length"]), []).append((r["t"], r["value"], r["is_anomaly"], notes))
        assert found == want
