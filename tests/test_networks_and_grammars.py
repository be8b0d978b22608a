"""Echo state networks and grammars against plain forms."""

from __future__ import annotations

import math
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsquorum.operators import detectors, echo
from tsquorum.operators.grammar import Grammar, covering_mean, density, sparse_intervals

RNG = np.random.default_rng(7)


def expanded(rules: dict, k: int = 0) -> list:
    return [y for x in rules[k] for y in (expanded(rules, x[1]) if isinstance(x, tuple) else [x])]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5).flatmap(lambda k: st.lists(st.integers(0, k - 1), max_size=120)))
def test_grammar_laws(symbols):
    """It gives the sequence back, no pair occurs twice (but for overlaps), every rule is used twice."""
    grammar = Grammar.of(symbols)
    rules = grammar.rules()
    assert expanded(rules) == symbols
    pairs, uses = Counter(), Counter(x[1] for body in rules.values() for x in body if isinstance(x, tuple))
    for body in rules.values():
        last: dict = {}
        for i, pair in enumerate(zip(body, body[1:], strict=False)):
            if last.get(pair) != i - 1:
                last[pair] = i
                pairs[pair] += 1
    assert max(pairs.values(), default=0) <= 1
    assert all(uses[r] >= 2 for r in rules if r)
    for rule, a, b in grammar.occurrences():
        assert symbols[a:b] == expanded(rules, rule)
    assert len(grammar.occurrences()) >= sum(uses[x] for x in rules if x)


def test_published_grammars():
    assert Grammar.of("abcdbc").rules() == {0: ["a", ("R", 1), "d", ("R", 1)], 1: ["b", "c"]}
    (top, first, second) = Grammar.of("abcdbcabcdbc").rules().values()
    assert top[0] == top[1] and first == ["b", "c"] and second == ["a", ("R", 1), "d", ("R", 1)]
    assert Grammar.of("aaaa").rules() == {0: [("R", 1), ("R", 1)], 1: ["a", "a"]}
    assert Grammar.of("").rules() == {0: []} and Grammar.of("ab").occurrences() == []


def test_density_and_covering_mean_equal_plain_sums():
    words = "abcabcxabcabcab"
    grammar = Grammar.of(words)
    begins, n = np.arange(len(words)) * 2, 2 * len(words) + 3
    plain = np.zeros(n)
    for _, a, b in grammar.occurrences():
        plain[begins[a] : begins[b - 1] + 4] += 1
    assert (density(grammar, begins, begins + 4, n) == plain).all()
    intervals = [(0, 5, 0.5), (3, 10, 0.25), (3, 2, 0.0), (18, 9, 1.0)]
    want = [np.mean(x) if (x := [s for b, k, s in intervals if s > 0 and b <= i < b + k]) else 0 for i in range(20)]
    assert np.allclose(covering_mean(intervals, 20), want)
    assert sparse_intervals(np.array([2, 2, 1, 0, 0, 2.0])) == [(2, 1, 0.5), (3, 2, 1.0)] and sparse_intervals(np.zeros(4)) == []


def test_a_long_series_takes_seconds():
    x = np.sin(np.arange(100_000) / 15) + 0.1 * RNG.standard_normal(100_000)
    x[60_000:60_080] = 0
    begin = time.process_time()
    score = detectors.execute(x, "grammarviz", {})
    assert time.process_time() - begin < 15
    assert score.shape == x.shape and score[60_000:60_080].mean() > 1.2 * score[:59_000].mean()


@pytest.mark.parametrize("n,k", [(1, 1), (5, 3), (8, 8)])
def test_cosines_equal_plain_sums(n, k):
    f = RNG.standard_normal(n)
    plain = [sum(f[x] * math.cos(math.pi * j * (x + 0.5) / n) for x in range(n)) * math.sqrt((1 if j == 0 else 2) / n) for j in range(n)]
    assert np.allclose(echo.cosine_matrix(n) @ f, plain)
    basis = echo.cosine_basis(n, k)
    assert basis.shape == (n, k) and np.allclose(basis, [[2 * math.cos(math.pi * (x + 0.5) * j / n) for j in range(k)] for x in range(n)])
    assert np.allclose(basis @ echo.slow_cosine(basis @ np.arange(k), basis), basis @ np.arange(k))
    image = RNG.standard_normal((n, 4))
    whole = echo.cosine2(image)
    plain2 = [[sum(image[y, x] * echo.cosine_matrix(n)[i, y] * echo.cosine_matrix(4)[j, x] for y in range(n) for x in range(4)) for j in range(4)] for i in range(n)]
    assert np.allclose(whole, plain2) and np.allclose(echo.inverse_cosine2(whole, (n, 4)), image)
    assert echo.cosine2(image, k, 2).shape == (k, 2)
    rows, columns = echo.cosine_basis(n, n), echo.cosine_basis(4, 4)
    assert np.allclose(echo.inverse_slow_cosine2(echo.slow_cosine2(image, rows, columns), rows, columns), image)


def test_trends_come_off_and_back():
    t = np.arange(120.0)
    wave = np.tile(RNG.standard_normal(12), 10)
    f = np.stack([3 + 0.1 * t - 0.002 * t**2 + wave, wave], axis=1)
    rest, b, cycle = echo.without_trend(f, 12)
    assert np.abs(rest[:, 0]).std() < 0.2 * f[:, 0].std() and cycle.shape == (12, 2)
    assert np.allclose(echo.with_trend(rest, b, cycle), f)
    assert np.allclose(echo.polynomial_trend(f[:, 0] - wave, 2), [3, 0.1, -0.002])
    rest, b, cycle = echo.without_trend(f[:115], 12, 230)
    assert np.allclose(echo.with_trend(rest, b, cycle, 230), f[:115])
    flat, b, cycle = echo.without_trend(f[:96], 12)
    assert np.abs(echo.with_trend(np.zeros((24, 2)), b, cycle, start=96) - f[96:])[:, 1].max() < 0.2
    assert np.allclose(echo.stretched(echo.stretched(f, 300), 120), f)
    with pytest.raises(ValueError, match="cycle"):
        echo.without_trend(f[:5], 12)


def test_metric_and_readouts():
    a, b = RNG.standard_normal((2, 4, 3, 2))
    metric = echo.image_metric((3, 2))
    plain = [sum((x - y)[p] * (x - y)[q] * math.exp(-((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) / 2) / (2 * math.pi) for p in np.ndindex(3, 2) for q in np.ndindex(3, 2)) for x, y in zip(a, b, strict=True)]
    assert np.allclose(echo.image_distance(a, b, metric), plain) and np.allclose(echo.image_distance(a, b), ((a - b) ** 2).sum(axis=(1, 2)))
    root, back = echo.metric_roots(metric)
    assert np.allclose(root @ root, metric) and np.allclose(root @ back, np.eye(6))
    inputs, states, labels = RNG.standard_normal((3, 40, 5)), RNG.standard_normal((3, 40, 6)), RNG.standard_normal((3, 40, 5))
    x = np.concatenate([np.ones((3, 40, 1)), inputs, states], axis=2)
    want = np.stack([np.linalg.lstsq(x[k], labels[k], rcond=None)[0].T for k in range(3)])
    assert np.allclose(echo.readout(inputs, states, labels), want) and np.allclose(echo.readout(inputs, states, labels, "pinv_lstsq"), want)
    assert np.allclose(echo.readout(inputs, states, labels, "tikhonov", 1e-9), want, atol=1e-6)
    assert np.allclose(echo.readout(inputs, states, labels, metric=np.eye(5)), want)
    twice = np.concatenate([inputs, inputs], axis=2)  # singular: the small values are left out
    assert np.allclose(np.concatenate([np.ones((3, 40, 1)), twice, states], axis=2) @ np.swapaxes(echo.readout(twice, states, labels), 1, 2), x @ np.swapaxes(want, 1, 2))
    with pytest.raises(ValueError):
        echo.readout(inputs, states, labels, "tikhonov")


def test_input_maps():
    image = np.arange(12.0).reshape(3, 4)
    assert np.allclose(echo.resampled(image, (3, 4)), image) and np.allclose(echo.resampled(image, (5, 7))[::2, ::2], image)
    assert np.allclose(echo.kernel("gauss", (3, 3), RNG).sum(), 1) and np.allclose(echo.kernel("mean", (2, 2), RNG), 0.25)
    w = RNG.standard_normal((2, 2))
    valid = [[sum(image[i + a, j + b] * w[1 - a, 1 - b] for a in range(2) for b in range(2)) for j in range(3)] for i in range(2)]
    spread = 2 * (np.array(valid) - np.min(valid)) / np.ptp(valid) - 1
    assert np.allclose(echo.features(image, [{"type": "convolution", "weights": w, "scale": 3}]), 3 * spread.ravel())
    maps = [{"type": "pixels", "size": (2, 2)}, {"type": "cosine", "size": (2, 3)}, {"type": "gradient"}, {"type": "convolution", "weights": w, "same": True}, {"type": "chain", "maps": [{"type": "pixels", "size": (2, 2)}, {"type": "gradient"}]}]
    assert len(echo.features(image, maps)) == 4 + 6 + 24 + 12 + 8
    assert len(echo.Network((3, 4), 9, 1.0, 0.5, 0.5, RNG, maps).mapped(np.zeros((5, 3, 4)))[0]) == 54
    assert np.isclose(np.abs(np.linalg.eigvals(echo.reservoir(30, 4, 1.7, RNG))).max(), 1.7)


def test_predictions_equal_one_step_after_another():
    images = RNG.standard_normal((30, 4, 2))
    network = echo.Network((4, 2), 12, 0.5, 0.9, 0.5, RNG)
    got = echo.predicted(images, network, 15, 3, 4, together=5)
    m = network.maps[0]
    cell = lambda image, state: np.tanh(m["scale"] * (m["weights"] @ image.ravel() + m["bias"]) + network.weights @ state)
    assert got.shape == (12, 3, 4, 2)
    for s in (0, 7, 11):
        state, states = np.zeros(12), []
        for image in images[s : s + 15]:
            state = cell(image, state)
            states.append(state)
        w = echo.readout(images[s + 4 : s + 15].reshape(11, -1), np.array(states[4:]), images[s + 5 : s + 16].reshape(11, -1))
        image = images[s + 15]
        for t in range(3):
            state = cell(image, state)
            image = (w @ np.concatenate([[1], image.ravel(), state])).reshape(4, 2)
            assert np.allclose(got[s, t], image)


def test_window_scores_equal_plain_loops():
    error = RNG.random((60, 3))
    got = echo.window_scores(error, 4, 20)
    for i in range(2, 60):
        past, future = error[max(0, i - 19) : i], error[i : i + 4]
        x = np.maximum(0, future.mean(axis=0) - past.mean(axis=0)) / (past.std(axis=0) + (past.std(axis=0) < 1e-10))
        assert np.allclose(got[i], [math.erf(v / math.sqrt(2)) for v in x])
    assert (got[:2] == 0).all()


def test_detector_finds_the_unexpected_in_one_and_two_dimensions():
    t = np.arange(2000)
    x = np.sin(2 * np.pi * t / 50) + 0.02 * RNG.standard_normal(2000)
    x[1500:1540] = 0
    for params in ({}, {"imed_loss": True}, {"train_method": "tikhonov", "tikhonov_beta": 1e-3}, detectors.DETECTORS["torsk"].for_period(50)):
        score = detectors.execute(x, "torsk", params)
        assert score.shape == x.shape and np.isfinite(score).all()
    base = detectors.DETECTORS["torsk"].defaults
    # A score looks at 100 points to come, each predicted from up to 100 points before.
    assert 1200 < echo.echo_scores(x, base, np.random.default_rng(1)).argmax() < 1700
    both = echo.echo_scores(np.stack([np.cos(t / 9), x], axis=1), base, np.random.default_rng(1))
    assert both.shape == (2000,) and 1200 < both.argmax() < 1700
    for n in (4, 30, 71, 200):
        assert np.isfinite(echo.echo_scores(x[:n], base, RNG)).all()
    assert (echo.echo_scores(np.ones(400), base, RNG) == 0).all()
