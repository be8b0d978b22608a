"""Base detectors: kernels over one series, run for many series at a time by ``applyInPandas``.

A detector is a function (values, params, rng) -> scores per point, with defaults, a search space and the views it
supports on series with cut points. Series stay independent, so work grows with the number of series; one series must
fit into a task's memory, as length limits ensure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquorum.operators.batches import by_batches
from tsquorum.operators.echo import echo_scores
from tsquorum.operators.grammar import Grammar, covering_mean, density, sparse_intervals

SEED = 42
#: Points of the shortest series that is scored.
LEAST_POINTS = 4
#: Settings that ride with every series.
MOST_JOBS = 1000


def windows(x: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, min(width, len(x)))


def to_points(scores: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mean over the windows that cover a point."""
    total, count = np.zeros(n + 1), np.zeros(n + 1)
    begins = np.arange(len(scores))
    np.add.at(total, begins, scores), np.add.at(total, begins + width, -scores)
    np.add.at(count, begins, 1), np.add.at(count, begins + width, -1)
    return np.cumsum(total)[:n] / np.maximum(np.cumsum(count)[:n], 1)


def _neighbours(w: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances to and places of the ``k`` nearest other windows, in blocks of rows."""
    k = max(1, min(k, len(w) - 1))
    out_d, out_i = np.zeros((len(w), k)), np.zeros((len(w), k), int)
    step = max(1, 2_000_000 // max(1, len(w)))
    square = (w**2).sum(axis=1)
    for lo in range(0, len(w), step):
        part = w[lo : lo + step]
        if p == 2:
            d = np.sqrt(np.maximum(square[lo : lo + step, None] - 2 * part @ w.T + square, 0))
        else:
            d = np.stack([(np.abs(w - row) ** p).sum(axis=1) ** (1 / p) for row in part])
        d[np.arange(len(part)), lo + np.arange(len(part))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        near_d = np.take_along_axis(d, near, axis=1)
        order = np.argsort(near_d, axis=1, kind="stable")
        out_d[lo : lo + step], out_i[lo : lo + step] = np.take_along_axis(near_d, order, axis=1), np.take_along_axis(near, order, axis=1)
    return out_d, out_i


def lof(x: np.ndarray, params: dict, rng: np.random.Generator) -> np.ndarray:
    """Local outlier factor of subsequences."""
    w = windows(x, params["window_size"])
    if len(w) < 3:
        return np.zeros(len(x))
    d, i = _neighbours(w, params["n_neighbors"], params.get("p", 2))
    reach = np.maximum(d, d[i, -1])
    density = 1 / (reach.mean(axis=1) + 1e-10)
    return to_points(density[i].mean(axis=1) / density, w.shape[1], len(x))


def knn(x: np.ndarray, params: dict, rng: np.random.Generator) -> np.ndarray:
    """Distance of subsequences to their neighbours: the largest, mean or median of k."""
    w = windows(x, params["window_size"])
    if len(w) < 2:
        return np.zeros(len(x))
    d, _ = _neighbours(w, params["n_neighbors"], params.get("p", 2))
    score = {"largest": d[:, -1], "mean": d.mean(axis=1), "median": np.median(d, axis=1)}[params.get("method", "largest")]
    return to_points(score, w.shape[1], len(x))


def _expected_path(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, float)
    return np.where(k > 2, 2 * (np.log(np.maximum(k - 1, 1)) + np.euler_gamma) - 2 * (k - 1) / np.maximum(k, 1), np.where(k == 2, 1.0, 0.0))


def isolation_forest(x: np.ndarray, params: dict, rng: np.random.Generator) -> np.ndarray:
    """Isolation forest of subsequences: 2 ** (-mean path / expected path)."""
    w = windows(x, params["window_size"])
    n = len(w)
    m = int(min(n, params["max_samples"] if params["max_samples"] > 1 else max(2, params["max_samples"] * n)))
    limit = int(np.ceil(np.log2(max(m, 2))))
    expected, total = _expected_path, np.zeros(n)

    def grow(sample: np.ndarray, rows: np.ndarray, depth: int) -> None:
        if depth >= limit or len(sample) <= 1 or not len(rows):
            total[rows] += depth + expected(len(sample))
            return
        f = rng.integers(w.shape[1])
        lo, hi = w[sample, f].min(), w[sample, f].max()
        if lo == hi:
            total[rows] += depth + expected(len(sample))
            return
        cut = rng.uniform(lo, hi)
        left_s, left_r = w[sample, f] < cut, w[rows, f] < cut
        grow(sample[left_s], rows[left_r], depth + 1)
        grow(sample[~left_s], rows[~left_r], depth + 1)

    for _ in range(params["n_trees"]):
        sample = rng.integers(n, size=m) if params.get("bootstrap") else rng.permutation(n)[:m]
        grow(sample, np.arange(n), 0)
    score = 2 ** (-total / params["n_trees"] / max(float(expected(m)), 1e-12))
    return to_points(score, w.shape[1], len(x))


#: Windows of the longest series whose forest is made along with others, and trees times windows squared, which its table of draws grows with.
MOST_WINDOWS, MOST_DRAWS = 128, 2_000_000


@lru_cache(maxsize=1)
def _draws(seed: int, trees: int, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """What numpy's generator draws from its words, enough of them for ``trees`` over ``most`` windows: their halves, the lower one first;
    columns below ``width`` from halves; numbers in [0, 1) from words; and the half after a permutation of n that begins at a half, by n - 1.

    A permutation draws a number up to each i from n - 1 to 1 and takes the next half until its lower bits are no more than i. None if
    a half would be drawn again for a column.
    """
    raw = np.random.default_rng(seed).bit_generator.random_raw(trees * (most + 2 * most + 2) + 500)
    halves = np.stack([raw & 0xFFFFFFFF, raw >> 32], axis=1).ravel()
    if ((halves * np.uint64(width) & np.uint64(0xFFFFFFFF)) < (2**32 - width) % width).any():
        return None
    end = len(halves)
    ends = np.empty((most, end + 1), np.int32)
    ends[0] = np.arange(end + 1)
    for i in range(1, most):
        fits = np.where(halves & np.uint64((1 << i.bit_length()) - 1) <= i, np.arange(1, end + 1), end)
        ends[i, :end] = ends[i - 1][np.minimum.accumulate(fits[::-1])[::-1]]
        ends[i, end] = end
    return halves, (halves * np.uint64(width) >> np.uint64(32)).astype(np.int64), (raw >> 11) * 2.0**-53, ends


def isolation_forests(series: list[np.ndarray], params: dict, seed: int) -> list[np.ndarray]:
    """Isolation forests of many series at once, each as ``isolation_forest`` makes it with a generator of its own: the same draws
    in the same order, a node of every series in one step.

    Long series, and those with more windows than ``max_samples``, whose trees see only some, go one by one.
    """
    width, trees = params["window_size"], params["n_trees"]
    n = np.array([len(x) - width + 1 for x in series])
    whole = (n > 1) & (n <= min(params["max_samples"], MOST_WINDOWS)) & (trees * n * n <= MOST_DRAWS) & (width > 1) & (not params.get("bootstrap")) & (params["max_samples"] > 1)
    limit = np.ceil(np.log2(np.maximum(n, 2))).astype(int)
    most = int(n[whole].max(initial=0))
    drawn = _draws(seed, trees, width, 1 << max(most - 1, 1).bit_length()) if whole.any() else None
    if drawn is None:
        whole[:] = False
    out = [None if w else isolation_forest(x, params, np.random.default_rng(seed)) for x, w in zip(series, whole, strict=True)]
    lanes = np.flatnonzero(whole)
    if not len(lanes):
        return out
    halves, columns, uniform, ends = drawn
    n, limit, x = n[lanes], limit[lanes], np.concatenate([series[i] for i in lanes])
    x_at = np.cumsum([0, *(len(series[i]) for i in lanes)])[:-1]
    w_at = np.cumsum(n) - n
    window = np.arange(n.sum()) - np.repeat(w_at, n)  # each series' windows, those of a node side by side
    expected, total = _expected_path(np.arange(most + 1)), np.zeros(n.sum())
    word, half, half_of, done, top = (np.zeros(len(n), int) for _ in range(5))  # the next word, whether the upper half of ``half_of`` comes first
    stack = np.zeros((len(n), int(limit.max()) + 2, 3), int)
    mask = np.array([(1 << int(k - 1).bit_length()) - 1 for k in n], np.uint64)
    live = np.arange(len(n))
    while True:
        fresh = live[top[live] == 0]
        if len(fresh):
            fresh = fresh[done[fresh] < trees]
            last = n[fresh] - 1
            fits = (half[fresh] > 0) & (halves[2 * half_of[fresh] + 1] & mask[fresh] <= last)
            after = ends[last - fits, 2 * word[fresh]]
            word[fresh], half[fresh], half_of[fresh] = (after + 1) // 2, after % 2, (after - 1) // 2
            stack[fresh, 0] = np.stack([np.zeros(len(fresh), int), n[fresh], np.zeros(len(fresh), int)], axis=1)
            done[fresh], top[fresh] = done[fresh] + 1, 1
            live = live[top[live] > 0]
        if not len(live):
            break
        top[live] -= 1
        b, e, depth = stack[live, top[live]].T
        upper, first = half[live], word[live]
        column = columns[np.where(upper, 2 * half_of[live] + 1, 2 * first)]
        half_of[live], half[live], after = np.where(upper, half_of[live], first), 1 - upper, first + 1 - upper
        size = e - b
        begin = np.cumsum(size) - size
        lane, place = np.repeat(np.arange(len(live)), size), np.arange(size.sum())
        at = place + (w_at[live] + b - begin)[lane]
        rows = window[at]
        value = x[rows + (x_at[live] + column)[lane]]
        lo, hi = np.minimum.reduceat(value, begin), np.maximum.reduceat(value, begin)
        split = lo < hi
        word[live] = after + split
        cut = lo + (hi - lo) * uniform[after]
        less = value < cut[lane]
        lefts = np.cumsum(less)
        left = lefts[begin + size - 1] - lefts[begin] + less[begin]
        rank = lefts - (lefts[begin] - less[begin])[lane]
        moved = np.empty_like(rows)
        moved[np.where(less, begin[lane] + rank - 1, left[lane] + place - rank)] = rows
        window[at] = moved
        right, deep = size - left, depth + 1 >= limit[live]
        ends_left, ends_right = split & (deep | (left <= 1)), split & (deep | (right <= 1))
        path_left = np.where(ends_left, depth + 1 + expected[left], 0.0)
        path_right = np.where(split, np.where(ends_right, depth + 1 + expected[right], 0.0), depth + expected[size])
        total[rows + w_at[live][lane]] += np.where(less, path_left[lane], path_right[lane])
        for goes, lower, higher in ((split & ~ends_right, b + left, e), (split & ~ends_left, b, b + left)):
            to = live[goes]
            stack[to, top[to]] = np.stack([lower[goes], higher[goes], depth[goes] + 1], axis=1)
            top[to] += 1
    for i, (at, k) in zip(lanes, zip(w_at, n, strict=True), strict=True):
        score = 2 ** (-total[at : at + k] / trees / max(float(expected[k]), 1e-12))
        out[i] = to_points(score, width, len(series[i]))
    return out


def matrix_profile(x: np.ndarray, params: dict, rng: np.random.Generator) -> np.ndarray:
    """Distance of z-normalized subsequences to their nearest non-trivial match, by running dot products."""
    m = max(3, min(params["window_size"], len(x) // 2))
    n = len(x) - m + 1
    if n < 2:
        return np.zeros(len(x))
    w = windows(x, m)
    mean, std = w.mean(axis=1), w.std(axis=1)
    apart = max(1, m // 4)
    first = np.convolve(x, x[:m][::-1], "valid")
    dots, best = first.copy(), np.full(n, np.inf)
    flat = std < 1e-12
    for i in range(n):
        if i:
            dots[1:] = dots[:-1] - x[i - 1] * x[: n - 1] + x[i + m - 1] * x[m:]
            dots[0] = first[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = (dots - m * mean[i] * mean) / (m * std[i] * std)
        d = np.sqrt(np.maximum(2 * m * (1 - np.clip(corr, -1, 1)), 0))
        d = np.where(flat[i] & flat, 0.0, np.where(flat[i] | flat, np.sqrt(m), d))
        d[max(0, i - apart) : i + apart + 1] = np.inf
        best[i] = d.min()
    best[~np.isfinite(best)] = 0
    return to_points(best, m, len(x))


def k_means(x: np.ndarray, params: dict, rng: np.random.Generator) -> np.ndarray:
    """Distance of subsequences to the centre of their own cluster."""
    w = windows(x, params["window_size"])
    k = max(1, min(params["n_clusters"], len(w)))
    centres = [w[rng.integers(len(w))]]
    near = ((w - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and near.sum() > 0:
        centres.append(w[rng.choice(len(w), p=near / near.sum())])
        near = np.minimum(near, ((w - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres, float)
    own = np.zeros(len(w), int)
    for _ in range(50):
        d = (w**2).sum(axis=1)[:, None] - 2 * w @ c.T + (c**2).sum(axis=1)
        new = d.argmin(axis=1)
        if (new == own).all() and _:
            break
        own = new
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, w)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return to_points(np.sqrt(((w - c[own]) ** 2).sum(axis=1)), w.shape[1], len(x))


def haar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of the Haar transform: (approximation, detail)."""
    return (x[::2] + x[1::2]) / np.sqrt(2), (x[::2] - x[1::2]) / np.sqrt(2)


def dwt_mlead(x: np.ndarray, params: dict, rng: np.random.Generator) -> np.ndarray:
    """Counts of unlikely coefficients: at every level windows of coefficients below a quantile of the likelihood of
    a normal law push a count down to the points beneath; counts under 2 are 0."""
    n = len(x)
    size = 1 << int(np.ceil(np.log2(max(n, 2))))
    padded = np.resize(x, size)
    levels, a = [], padded
    while len(a) > 1:
        a, d = haar(a)
        levels.append((a, d))
    depth = len(levels)
    start, score = min(params["start_level"], depth - 1), np.zeros(size)
    for level in range(start, depth):
        for coefficients in levels[level]:
            w = windows(coefficients, max(2, depth - level))
            if len(w) < 3:
                continue
            mean = w.mean(axis=0)
            cov = np.atleast_2d(np.cov(w, rowvar=False)) + 1e-6 * np.eye(w.shape[1])
            diff = w - mean
            likelihood = -0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(cov), diff)
            marked = likelihood < np.quantile(likelihood, params["quantile_epsilon"])
            hits = np.zeros(len(coefficients))
            for i in np.flatnonzero(marked):
                hits[i : i + w.shape[1]] += 1
            score += np.repeat(hits, size // len(coefficients))
    score = np.where(score < 2, 0, score)
    return score[:n]


def cluster_anomalies(counts: np.ndarray, d_max: float, least: float = 2) -> list[tuple[float, float]]:
    """(centre, summed score) of the groups of marked points that are at most ``d_max`` apart."""
    at = np.flatnonzero(counts >= least)
    groups = np.split(at, np.flatnonzero(np.diff(at) > d_max) + 1) if len(at) else []
    return [(float((g * counts[g]).sum() / counts[g].sum()), float(counts[g].sum())) for g in groups]


def echo_state(x: np.ndarray, params: dict, rng: np.random.Generator) -> np.ndarray:
    """Prediction error of an echo state network over blocks of points, see ``operators.echo``."""
    return echo_scores(x, params, rng)


def past_future(error: np.ndarray, small: int, large: int) -> np.ndarray:
    """1 - normal tail of the mean of the next ``small`` errors under the ``large - 1`` before."""
    c, c2 = np.concatenate([[0], np.cumsum(error)]), np.concatenate([[0], np.cumsum(error**2)])
    n, i = len(error), np.arange(len(error))
    b, e = np.maximum(0, i - large + 1), np.minimum(n, i + small)
    k = np.maximum(i - b, 1)
    mean = (c[i] - c[b]) / k
    std = np.sqrt(np.maximum((c2[i] - c2[b]) / k - mean**2, 0))
    z = ((c[e] - c[i]) / np.maximum(e - i, 1) - mean) / np.maximum(std, 1e-9)
    score = 1 - np.exp(-np.maximum(z, 0) / np.sqrt(2))
    score[i < 2] = 0
    return score


def paa(w: np.ndarray, segments: int) -> np.ndarray:
    """Means of ``segments`` equal parts; windows that don't divide are cut fractionally."""
    m = w.shape[-1]
    edges = np.linspace(0, m, segments + 1)
    c = np.concatenate([np.zeros((*w.shape[:-1], 1)), np.cumsum(w, axis=-1)], axis=-1)
    low = np.floor(edges).astype(int)
    at = c[..., low] + (edges - low) * np.where(low < m, w[..., np.minimum(low, m - 1)], 0)
    return np.diff(at, axis=-1) / (m / segments)


#: Breakpoints that cut the standard normal law into equal parts, by alphabet size.
BREAKPOINTS = {3: (-0.43, 0.43), 4: (-0.67, 0.0, 0.67), 5: (-0.84, -0.25, 0.25, 0.84), 6: (-0.97, -0.43, 0.0, 0.43, 0.97)}


def sax(x: np.ndarray, width: int, segments: int, alphabet: int, flat: float = 0.01, together: int = 10_000) -> list[str]:
    """A word per window, of the z-normalized window's segment means; windows are taken ``together`` at a time."""
    every, out = windows(x, width), []
    for lo in range(0, len(every), together):
        w = every[lo : lo + together].astype(float)
        std = w.std(axis=1, keepdims=True)
        z = (w - w.mean(axis=1, keepdims=True)) / np.where(std < flat, 1.0, std)
        codes = np.searchsorted(BREAKPOINTS[alphabet], paa(z, segments), side="right").astype(np.uint8) + 97
        out += [row.tobytes().decode() for row in codes]
    return out


def rule_density(x: np.ndarray, params: dict, rng: np.random.Generator) -> np.ndarray:
    """Grammar-rule density: the words of the series become a grammar (``operators.grammar``); stretches under fewer rules than the
    densest one are anomalies, and a point takes the mean score of those that cover it. Repeats of a word in a row count once."""
    width = max(2, min(params["window_size"], len(x) // 2))
    words = sax(x, width, params["paa_size"], params["alphabet_size"], params.get("normalization_threshold", 0.01))
    at = np.array([i for i in range(len(words)) if i == 0 or words[i] != words[i - 1]])
    cover = density(Grammar.of(words[i] for i in at), at, at + width, len(x))
    return covering_mean(sparse_intervals(cover), len(x))


@dataclass(frozen=True)
class Detector:
    """A kernel with its defaults, its search space (low, high) or choices, and the views it takes."""

    run: Callable[[np.ndarray, dict, np.random.Generator], np.ndarray]
    defaults: dict
    space: dict = field(default_factory=dict)
    bad_defaults: dict = field(default_factory=dict)
    view: str = "sliding"
    #: Settings known to be good, instead of windows of one period.
    tuned: dict = field(default_factory=dict)
    #: The same for many series at once: (values of each, params, seed) -> scores of each.
    many: Callable[[list[np.ndarray], dict, int], list[np.ndarray]] | None = None

    def for_period(self, period: int) -> dict:
        """Defaults with windows of one period, or the known settings."""
        return self.defaults | (self.tuned or {k: period for k in ("window_size", "context_window_size") if k in self.defaults})


#: Names, default parameters and search spaces of the base detectors.
DETECTORS: dict[str, Detector] = {
    "subsequence_lof": Detector(lof, {"window_size": 100, "n_neighbors": 20, "p": 2}, {"window_size": (10, 1000), "n_neighbors": (1, 100), "p": (1, 4)}, {"window_size": 50, "n_neighbors": 50, "p": 1}),
    "subsequence_knn": Detector(knn, {"window_size": 100, "n_neighbors": 5, "method": "largest", "p": 2}, {"window_size": (10, 1000), "n_neighbors": (1, 100), "method": ["largest", "mean", "median"], "p": (1, 4)}, {"window_size": 50, "n_neighbors": 50, "method": "mean", "p": 1}),
    "subsequence_if": Detector(isolation_forest, {"window_size": 100, "n_trees": 100, "max_samples": 256, "bootstrap": False}, {"window_size": (10, 1000), "n_trees": (10, 1000), "max_samples": (0.1, 1.0), "bootstrap": [True, False]}, {"window_size": 50, "n_trees": 10, "max_samples": 64, "bootstrap": True}, many=isolation_forests),
    "stomp": Detector(matrix_profile, {"window_size": 100}, {"window_size": (10, 1000)}, {"window_size": 30}),
    "kmeans": Detector(k_means, {"window_size": 100, "n_clusters": 20}, {"window_size": (10, 1000), "n_clusters": (2, 100)}, {"window_size": 20, "n_clusters": 2}, "custom"),
    "dwt_mlead": Detector(dwt_mlead, {"start_level": 3, "quantile_epsilon": 0.01}, {"start_level": (1, 10), "quantile_epsilon": (0.001, 0.5)}, {"start_level": 1, "quantile_epsilon": 0.1}, "separated"),
    "torsk": Detector(
        echo_state,
        {"input_map_size": 10, "input_map_scale": 0.001, "context_window_size": 10, "train_window_size": 20, "prediction_window_size": 10, "transient_window_size": 10, "spectral_radius": 1.0, "density": 1.0, "imed_loss": False, "train_method": "pinv_svd", "tikhonov_beta": None, "scoring_small_window_size": 10, "scoring_large_window_size": 50},
        {"context_window_size": (10, 1000), "density": (0.0001, 1.0), "imed_loss": [True, False], "input_map_scale": (0.001, 1.0), "input_map_size": (10, 2000), "scoring_large_window_size": (50, 1000), "scoring_small_window_size": (10, 500), "spectral_radius": (1.0, 10.0), "train_window_size": (10, 1000), "prediction_window_size": (10, 1000), "transient_window_size": (10, 1000)},
        {"input_map_scale": 0.01, "train_window_size": 2, "prediction_window_size": 1, "transient_window_size": 1, "spectral_radius": 0.5},
        "tumbling",
        {"density": 0.01, "input_map_scale": 0.125, "input_map_size": 100, "prediction_window_size": 5, "scoring_large_window_size": 100, "spectral_radius": 2.0, "train_window_size": 100, "transient_window_size": 20},
    ),
    "grammarviz": Detector(rule_density, {"window_size": 100, "paa_size": 4, "alphabet_size": 4, "normalization_threshold": 0.01}, {"window_size": (10, 1000), "paa_size": (2, 6), "alphabet_size": (3, 6)}, {"window_size": 170, "paa_size": 4, "alphabet_size": 4}, "separated"),
}


def register(name: str, detector: Detector) -> None:
    DETECTORS[name] = detector


def execute(values: np.ndarray, algorithm: str | Detector, params: dict, regions: np.ndarray | None = None, seed: int = SEED) -> np.ndarray:
    """Scores of one series. With ``regions`` (a number per point) windows don't cross from one region to another;
    regions too short to be scored take the least score.

    A series with fewer than ``LEAST_POINTS`` points, or with values that aren't finite, has NaN scores, so that the instance drops out;
    whatever else goes wrong is an error. Workers don't know of detectors registered on the driver: hand over the detector itself there.
    """
    detector = DETECTORS[algorithm] if isinstance(algorithm, str) else algorithm
    params = detector.defaults | {k: v for k, v in params.items() if k in detector.defaults}
    values = np.asarray(values, float)

    def one(x: np.ndarray) -> np.ndarray:
        return np.asarray(detector.run(x, dict(params), np.random.default_rng(seed)), float)

    if len(values) < LEAST_POINTS or not np.isfinite(values).all():
        return np.full(len(values), np.nan)
    if regions is None or len(np.unique(regions)) < 2:
        return one(values)
    out = np.full(len(values), np.nan)
    need = max((int(v) for k, v in params.items() if k.endswith("window_size")), default=LEAST_POINTS)
    for r in np.unique(regions):
        at = regions == r
        if at.sum() >= max(need, LEAST_POINTS):
            out[at] = one(values[at])
    good = np.isfinite(out)
    return np.where(good, out, min(0.0, out[good].min()) if detector.view == "separated" and good.any() else (out[good].min() if good.any() else np.nan))


def execute_many(series: list[np.ndarray], detector: Detector, params: dict, seed: int = SEED) -> list[np.ndarray]:
    """Scores of many series, those of ``execute`` for each."""
    params = detector.defaults | {k: v for k, v in params.items() if k in detector.defaults}
    good = [len(x) >= LEAST_POINTS and bool(np.isfinite(x).all()) for x in series]
    found = iter(detector.many([x for x, g in zip(series, good, strict=True) if g], params, seed))
    return [np.asarray(next(found), float) if g else np.full(len(x), np.nan) for x, g in zip(series, good, strict=True)]


def run_detectors(points: DataFrame, jobs: DataFrame, by: list[str], region: str | None = None, seed: int = SEED) -> DataFrame:
    """(by.., instance, t, score) for every series and every job (instance, algorithm, params_json).

    Jobs are few; they ride with the series as an array, then every (series, job) is a group of its own, so one long
    list of jobs doesn't make one long task. ``region`` names a column that windows must not cross.
    """
    import json

    listed = [r.asDict() for r in jobs.select("instance", "algorithm", "params_json").limit(MOST_JOBS + 1).collect()]
    if len(listed) > MOST_JOBS:
        raise ValueError(f"more than {MOST_JOBS} settings; run them as trials, which are a table")
    column = F.array(*[F.lit(j["instance"]) for j in listed])
    spread = points.select(*by, "t", "value", (F.col(region) if region else F.lit(0)).cast("long").alias("_region"), F.explode(column).alias("instance"))
    settings = {j["instance"]: (DETECTORS[j["algorithm"]], json.loads(j["params_json"] or "{}")) for j in listed}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        algorithm, params = settings[key[-1]]
        score = execute(rows["value"].to_numpy(float), algorithm, params, rows["_region"].to_numpy() if region else None, seed)
        return pd.DataFrame({**{k: v for k, v in zip(by, key, strict=False)}, "instance": key[-1], "t": rows["t"].to_numpy(), "score": score})

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in points.select(*by).schema] + ["instance string, t bigint, score double"])
    if region is None and all(detector.many for detector, _ in settings.values()):

        def run_many(table: pa.Table, begins: np.ndarray) -> pa.Table:
            names = table.column("instance").take(pa.array(begins)).to_pylist()
            series = np.split(table.column("value").to_numpy().astype(float), begins[1:])
            scores: list = [None] * len(series)
            for name in dict.fromkeys(names):
                own = [i for i, one in enumerate(names) if one == name]
                for i, s in zip(own, execute_many([series[i] for i in own], *settings[name], seed), strict=True):
                    scores[i] = s
            return table.select([*by, "instance", "t"]).append_column("score", pa.array(np.concatenate(scores), pa.float64(), from_pandas=True))

        return by_batches(spread.select(*by, "instance", F.col("t").cast("long").alias("t"), "value"), [*by, "instance"], run_many, schema)
    return spread.groupBy(*by, "instance").applyInPandas(run, schema)


# ------------------------------------------------------------------------------------------ native forms


def paa_frame(blocks: DataFrame, by: list[str], width: int, segments: int) -> DataFrame:
    """(by.., segment, mean) of windows ``width`` long given as rows (by.., t, value): plain group means."""
    place = F.floor(F.col("t") % width * segments / width).cast("long")
    return blocks.groupBy(*by, F.floor(F.col("t") / width).cast("long").alias("block"), place.alias("segment")).agg(F.avg("value").alias("mean"))


def sax_letters(mean, alphabet: int):
    """The letter of a normalized mean."""
    code = sum((F.when(mean >= b, 1).otherwise(0) for b in BREAKPOINTS[alphabet][1:]), F.when(mean >= BREAKPOINTS[alphabet][0], 1).otherwise(0))
    return F.chr(F.lit(97) + code)


def haar_frame(points: DataFrame, by: list[str]) -> DataFrame:
    """One Haar level as a group-by of neighbouring pairs; an odd last point is left out."""
    even = F.col("t") % 2 == 0
    a, b = F.max(F.when(even, F.col("value"))), F.max(F.when(~even, F.col("value")))
    grouped = points.groupBy(*by, F.floor(F.col("t") / 2).cast("long").alias("t")).agg(a.alias("_a"), b.alias("_b")).where("_b is not null")
    root = F.lit(2.0**0.5)
    return grouped.select(*by, "t", ((F.col("_a") + F.col("_b")) / root).alias("approximation"), ((F.col("_a") - F.col("_b")) / root).alias("detail"))


def knn_frame(vectors: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by.., id, distance to the k-th neighbour, or to the last one where there are fewer) of vectors within ``by``, see ``operators.neighbours``."""
    from tsquorum.operators.neighbours import nearest_vectors

    return nearest_vectors(vectors, by, k).where(F.size("distances") > 0).select(*by, "id", F.array_max("distances").alias("distance"))
