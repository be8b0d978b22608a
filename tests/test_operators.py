"""Recomputed goldens and properties of the operators."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsquorum.functions import scalar
from tsquorum.operators import detectors, generation, injection, metrics, optimization, ranks, scores, selection, selective, slices, views

X = [0.0, 1.0, 2.0, 3.0, 4.0, 3.0, 2.0, 1.0, 0.0, 1.0]


def array(spark, column, x=X):
    return spark.createDataFrame([(x,)], "x array<double>").select(column(F.col("x")).alias("y")).first()["y"]


def mask(spark, bits):
    return spark.createDataFrame([(1, t, b == "1") for t, b in enumerate(bits)], "s int, t bigint, flag boolean")


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (injection.vmirror, [1, 0, 1, 2, 3, 4, 3, 2, 1, 0]),
        (lambda x: injection.compress(x, 0.5), [0, 2.25, 3.5, 1.25, 1]),
        (lambda x: injection.stretch(x, 0.5), [0, 0.6, 1.2, 1.8, 2.4, 3, 3.6, 3.8, 3.2, 2.6, 2, 1.4, 0.8, 0.2, 0.4, 1]),
        (lambda x: injection.scale(x, 0.4), [v * 1.05 for v in X]),
        (injection.hmirror, [3.4, 2.4, 1.4, 0.4, -0.6, 0.4, 1.4, 2.4, 3.4, 2.4]),
    ],
)
def test_transforms(spark, column, want):
    assert array(spark, column) == pytest.approx(want)


def test_smoothing_is_numpys_convolution(spark):
    kernel = injection.gaussian_kernel(10, 0.5)
    assert array(spark, lambda x: scalar.convolved(x, kernel)) == pytest.approx(np.convolve(X, kernel, "same").tolist())


def test_mask_to_slices_and_back(spark):
    m = mask(spark, "0110010111")
    s = slices.mask_to_slices(m, ["s"])
    assert sorted((r["b"], r["e"]) for r in s.collect()) == [(1, 3), (5, 6), (7, 10)]
    back = slices.slices_to_mask(s, spark.createDataFrame([(1, 10)], "s int, n bigint"), ["s"])
    assert {(r["t"], r["flag"]) for r in back.collect()} == {(r["t"], r["flag"]) for r in m.collect()}
    inverse = slices.invert_slices(s, ["s"], spark.createDataFrame([(1, 10)], "s int, n bigint"))
    assert sorted((r["b"], r["e"]) for r in inverse.collect()) == [(0, 1), (3, 5), (6, 7)]


def test_slices_of_empty_and_full_masks(spark):
    assert slices.mask_to_slices(mask(spark, "000"), ["s"]).count() == 0
    none = slices.mask_to_slices(mask(spark, "000"), ["s"])
    assert [(r["b"], r["e"]) for r in slices.invert_slices(none, ["s"], spark.createDataFrame([(1, 3)], "s int, n bigint")).collect()] == [(0, 3)]
    assert [(r["b"], r["e"]) for r in slices.mask_to_slices(mask(spark, "111"), ["s"]).collect()] == [(0, 3)]


def test_reverse_windowing_of_constant_scores_is_constant(spark):
    points = spark.createDataFrame([(1, t, float(t)) for t in range(12)], "s int, t bigint, value double")
    w = views.sliding(points, ["s"], 4).select("s", "t", F.lit(2.5).alias("score"))
    assert {r["score"] for r in views.reverse_sliding(w, points, ["s"], 4).collect()} == {2.5}
    assert views.sliding(points, ["s"], 13).count() == 0


def test_erf_and_inverse(spark):
    import math

    rows = spark.createDataFrame([(x / 10,) for x in range(-25, 26)], "x double").select("x", scalar.erf(F.col("x")).alias("e"), scalar.erfinv(scalar.erf(F.col("x"))).alias("i")).collect()
    for r in rows:
        assert abs(r["e"] - math.erf(r["x"])) < 2e-7
        if abs(r["x"]) < 2 and r["x"]:
            assert abs(r["i"] - r["x"]) < 1e-4


def test_formats(spark):
    row = spark.range(1).select(scalar.format_bytes(F.lit(1536)).alias("b"), scalar.format_nanos(F.lit(2_500_000_000)).alias("n"), scalar.clean_dataset_name(F.lit("test"), F.lit("KPI-x.test")).alias("d")).first()
    assert (row["b"], row["n"], row["d"]) == ("1.5 kiB", "2.50 s", "x")


def test_finite_and_minmax(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 5.0), ("b", 1, 5.0), ("c", 0, float("nan")), ("c", 1, 1.0)]
    s = spark.createDataFrame([(1, *r) for r in rows], "s int, instance string, t bigint, score double")
    good = scores.minmax(scores.finite_instances(s, ["s"]), ["s"])
    assert {(r["instance"], r["t"]): r["score"] for r in good.collect()} == {("a", 0): 0, ("a", 1): 1, ("b", 0): 0, ("b", 1): 0}


def votes(spark, table):
    return spark.createDataFrame([(0, v, f"{i:02d}", r) for v, row in enumerate(table) for i, r in enumerate(row)], "g int, voter bigint, item string, rank bigint")


VOTES = [[1, 0, 2, 4, 5, 8, 7, 6, 9, 3], [1, 0, 2, 4, 5, 8, 7, 6, 9, 3], [4, 4, 4, 5, 4, 5, 6, 4, 7, 2]]


def test_borda_of_equal_voters_is_theirs(spark):
    one = [3, 1, 0, 2, 4]
    found = ranks.borda(votes(spark, [one, one, one]), ["g"])
    assert [r["rank"] for r in found.orderBy("item").collect()] == one


def test_kendall_is_symmetric_and_counts_inversions(spark):
    v = votes(spark, [[0, 1, 2, 3], [3, 2, 1, 0], [0, 2, 1, 3]])
    d = {(r["voter"], r["other"]): r["distance"] for r in ranks.voter_distances(v, ["g"]).collect()}
    assert d[0, 1] == d[1, 0] == 6 and d[0, 2] == d[2, 0] == 1 and d[1, 2] == 5


def test_minimum_influence_is_one_of_the_voters(spark):
    v = votes(spark, VOTES)
    assert ranks.minimum_influence(v, ["g"]).select("voter").distinct().count() == 1


def test_kemeny_on_capitals():
    towns = ["Chattanooga", "Knoxville", "Memphis", "Nashville"]
    ballots = [(42, ["Memphis", "Nashville", "Chattanooga", "Knoxville"]), (26, ["Nashville", "Chattanooga", "Knoxville", "Memphis"]), (15, ["Chattanooga", "Knoxville", "Nashville", "Memphis"]), (17, ["Knoxville", "Chattanooga", "Nashville", "Memphis"])]
    wins = {(a, b): sum(n for n, o in ballots if o.index(a) < o.index(b)) for a in towns for b in towns if a != b}
    sums = {a: sum(wins[a, b] for b in towns if b != a) for a in towns}
    assert sums == {"Memphis": 126, "Nashville": 194, "Knoxville": 107, "Chattanooga": 173}
    assert ranks.kemeny_exact(wins, towns) == ["Nashville", "Chattanooga", "Knoxville", "Memphis"]
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 6):
        items = [f"i{k}" for k in range(n)]
        weight = {(a, b): int(rng.integers(0, 4)) for a in items for b in items if a != b}
        score = lambda o: sum(weight[a, b] for a, b in itertools.combinations(o, 2))  # noqa: E731, B023
        assert ranks.kemeny_exact(weight, items[::-1]) == list(max(itertools.permutations(items), key=score))
    many = [f"i{k:02d}" for k in range(12)]
    assert ranks.kemeny_exact({(a, b): 1 for a, b in itertools.combinations(many, 2)}, many[::-1]) == many
    assert ranks.kemeny_exact({}, [f"{k:02d}" for k in range(17)]) == [f"{k:02d}" for k in range(17)]


def test_perfect_and_random_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(1, t, t in (5, 6, 7), 1.0 if t in (5, 6, 7) else float(rng.random() / 2), t in (5, 6, 7)) for t in range(50)]
    p = spark.createDataFrame(rows, "s int, t bigint, is_anomaly boolean, score double, predicted boolean")
    assert metrics.roc_auc(p, ["s"]).first()["roc_auc"] == pytest.approx(1) and metrics.pr_auc(p, ["s"]).first()["pr_auc"] == pytest.approx(1)
    values = {r["metric"]: r["value"] for r in metrics.range_metrics(p, ["s"]).collect()}
    assert values["RangePrecision"] == values["RangeRecall"] == values["RangeFScore"] == 1
    assert metrics.panel(p, ["s"]).count() == 1


def test_detectors_find_a_planted_anomaly():
    rng = np.random.default_rng(0)
    x = np.sin(np.arange(3000) / 10) + rng.normal(0, 0.05, 3000)
    x[2000:2030] += 1.5  # after the 1000 points that the echo state network trains on
    y = np.zeros(3000, bool)
    y[2000:2030] = True
    for name, d in detectors.DETECTORS.items():
        s = detectors.execute(x, name, d.for_period(63))
        rank = np.argsort(np.argsort(s))
        auc = (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())
        assert len(s) == len(x) and auc > 0.7, (name, auc)
        again = detectors.execute(x, name, d.for_period(63))
        assert np.array_equal(s, again), name


def test_detectors_survive_odd_series():
    for name in detectors.DETECTORS:
        for x in (np.zeros(5), np.ones(200), np.array([1.0]), np.array([])):
            assert len(detectors.execute(x, name, {"window_size": 10})) == len(x)


def test_matrix_profile_equals_brute_force():
    rng = np.random.default_rng(3)
    x, m = rng.normal(size=120), 12
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    z = (w - w.mean(axis=1, keepdims=True)) / w.std(axis=1, keepdims=True)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    for i in range(len(d)):
        d[i, max(0, i - 3) : i + 4] = np.inf
    want = detectors.to_points(d.min(axis=1), m, len(x))
    assert np.allclose(detectors.matrix_profile(x, {"window_size": m}, rng), want, atol=1e-5)


def test_injection_changes_what_it_labels():
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(600) / 7)
    for kind in injection.TRANSFORMS:
        v, y, _, notes = injection.inject(x.copy(), np.zeros(600, bool), np.zeros(0, int), [kind], 40, rng)
        assert len(notes) == 1 and y.sum() == notes[0]["length"] and len(v) == len(y)
    assert injection.inject(x[:50], np.zeros(50, bool), np.zeros(0, int), ["scale"], 40, rng)[3] == []


def test_selection_methods(spark):
    rng = np.random.default_rng(4)
    rows = [(1, f"i{i}", t, float(rng.random() + i * (t % 3))) for i in range(8) for t in range(30)]
    s = spark.createDataFrame(rows, "series_id int, instance string, t bigint, score double")
    c = spark.createDataFrame([(f"i{i}", i % 4, 0.5 + i / 20) for i in range(8)], "instance string, no_datasets bigint, mean_train_quality double")
    for method in list(selection.SELECTIONS)[:11]:
        names = selection.select_instances(c, s, ["series_id"], method.replace("-", " ").title(), 3)
        assert 1 <= len(names) <= 3 and len(set(names)) == len(names), method
    with pytest.raises(ValueError, match="no selection"):
        selection.select_instances(c, s, ["series_id"], "none", 3)


def test_selective_ensemble_prefers_the_anomaly():
    rng = np.random.default_rng(0)
    y = np.zeros(400)
    y[200:210] = 4
    s = np.abs(np.stack([y + rng.normal(0, 0.5, 400) for _ in range(5)] + [rng.normal(0, 1, 400)], axis=1))
    for strategy in ("vertical", "horizontal"):
        r = selective.select_ensemble(s, strategy)
        assert r[200:210].mean() > 5 * r.mean() and r.min() > 0


def test_search_proposals_repeat_and_stay_in_space():
    for name, d in detectors.DETECTORS.items():
        a = optimization.proposals(name, 5, 1)
        assert a == optimization.proposals(name, 5, 1) and a[0] == d.defaults and len(a) == 7
        for p in a[2:]:
            for k, space in d.space.items():
                assert p[k] in space if isinstance(space, list) else space[0] <= p[k] <= space[1]


def test_tolerant_and_loose_sets(spark):
    one = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    two = spark.createDataFrame([(1.0000005,), (1.5,), (2.0,)], "v double")
    assert sorted(r["v"] for r in optimization.tolerant_common(one, two).collect()) == [1.0000005, 2.0]


def test_regimes_of_two_shapes(spark):
    x = np.concatenate([np.sin(np.arange(400) / 4), np.sign(np.sin(np.arange(400) / 4))])
    p = spark.createDataFrame([(1, t, float(v), 25) for t, v in enumerate(x)], "s int, t bigint, value double, period int")
    profiles = generation.regime_kernel(p, ["s"], "period", 2)
    assert profiles.select("regime").distinct().count() == 2


def test_choose_k_by_area(spark):
    a = spark.createDataFrame([(1, 1, 10.0), (1, 2, 4.0), (1, 3, 3.8), (2, 1, 10.0), (2, 2, 9.0)], "s int, k bigint, area double")
    assert {r["s"]: r["k"] for r in generation.choose_k(a, ["s"]).collect()} == {1: 2, 2: 1}


def test_least_cuts():
    regions = np.array([0] * 4 + [1] * 10 + [2] * 4)
    b, e = generation.least_cuts(regions, 8)
    assert regions[b] == regions[e - 1] == 1


def test_strength_laws():
    """Mean and variance of each transform's beta law, away from one half."""
    want = {"extremum": (2, 2), "compress": (1, 1), "stretch": (1, 1), "noise": (3, 1), "smoothing": (1, 1), "hmirror": (1e10, 1), "vmirror": (1e10, 1), "scale": (0.5, 0.5), "pattern": (1, 1)}
    for kind, law in want.items():
        rng = np.random.default_rng(5)
        drawn = np.array([injection.sample_strength(kind, rng) for _ in range(4000)])
        fair = np.random.default_rng(6).beta(*law, 40_000)
        fair = fair[np.abs(fair - 0.5) >= 0.05]
        assert abs(drawn.mean() - fair.mean()) < 0.02 and abs(drawn.var() - fair.var()) < 0.01, kind


def plain_range_auc(label, score, buffer):
    """Threshold by threshold."""
    n, half = len(label), buffer // 2
    soft = label.astype(float)
    ranges = metrics._ranges(label)
    for b, e in ranges:
        for at in [*range(max(0, b - half), b), *range(e, min(n, e + half))]:
            soft[at] = max(soft[at], max(0.0, 1 - (b - at if at < b else at - e + 1) / max(buffer, 1)) ** 0.5)
    positive, curve = (label.sum() + soft.sum()) / 2, [(0.0, 0.0, 1.0)]
    for th in np.sort(score)[::-1][np.unique(np.linspace(0, n - 1, 250).astype(int))]:
        found = score >= th
        tp, seen = (soft * found).sum(), np.mean([found[max(0, b - half) : e + half].any() for b, e in ranges])
        curve.append((min(tp / positive, 1) * seen, min(max((found.sum() - tp) / (n - positive), 0), 1), tp / found.sum()))
    roc = sum((f1 - f0) * (t1 + t0) / 2 for (t0, f0, _), (t1, f1, _) in zip(curve, [*curve[1:], (1.0, 1.0, 0.0)], strict=True))
    return roc, sum((t1 - t0) * p for (t0, _, _), (t1, _, p) in zip(curve, curve[1:], strict=False))


def test_range_areas_equal_a_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(20):
        label, score = np.zeros(200, bool), np.round(rng.random(200), rng.integers(1, 4))
        for b in rng.integers(0, 190, 3):
            label[b : b + 8] = True
        for buffer in (0, 1, 7, 30):
            assert metrics.range_auc(label, score, buffer) == pytest.approx(plain_range_auc(label, score, buffer), abs=1e-9)
    assert metrics.volumes(label, score, 10) == pytest.approx(np.mean([metrics.range_auc(label, score, b) for b in range(11)], axis=0))


def test_logarithms_fall_back_to_linear(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", 1, 4.0), (1, "b", 0, 0.0), (1, "b", 1, 4.0)], "s int, instance string, t int, score double")
    got = {(r["instance"], r["t"]): r["score"] for r in scores.regularized(df, ["s"], "inverse-log").collect()}
    assert got == {("a", 0): pytest.approx(np.log(4)), ("a", 1): 0, ("b", 0): 4, ("b", 1): 0}


def test_too_many_candidates_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST_CANDIDATES", 2)
    ranking = spark.createDataFrame([(f"i{k}", k) for k in range(3)], "instance string, rank int")
    with pytest.raises(ValueError, match="candidates"):
        selection._listed(ranking)


def test_profile_distances_equal_a_plain_version():
    rng = np.random.default_rng(8)
    x, width = rng.normal(size=60), 9
    half, share = 4, 0.05
    part = lambda at: (x[at : at + half] - x[at : at + half].mean()) / x[at : at + half].std()
    got = generation.profile_distances(x, 18, width)
    for at in range(len(x) - width + 1):
        ours, other = [part(18 + i) for i in range(width - half + 1)], [part(at + i) for i in range(width - half + 1)]
        near = sorted([min(np.linalg.norm(a - b) for b in other) for a in ours] + [min(np.linalg.norm(a - b) for b in ours) for a in other])
        assert got[at] == pytest.approx(near[int(np.ceil(share * 2 * width)) - 1], abs=1e-6)


def test_regimes_are_found(spark):
    t = np.arange(600)
    x = np.where(t < 300, np.sin(2 * np.pi * t / 24), (t % 24) / 12 - 1.0)
    df = spark.createDataFrame([(1, int(i), float(v), 24) for i, v in zip(t, x, strict=True)], "s int, t bigint, value double, period int")
    found = generation.regimes(generation.regime_kernel(df, ["s"], "period", 2), ["s"], 24).collect()
    assert any(r["b"] < 50 and 230 < r["e"] < 320 for r in found) and any(270 < r["b"] < 330 and r["e"] > 500 for r in found)
