"""Selective ensembles without training data: vertical and horizontal selection, consensus, four phases."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsquorum.functions.scalar import erf
from tsquorum.operators import ranks as rk
from tsquorum.operators import scores as sc

#: The kernels take matrices of at most this many values on the driver; longer series are scored through frames only.
MOST_VALUES = 50_000_000


def weighted_correlation(rows: DataFrame, by: list[str], a: Column, b: Column, w: Column) -> DataFrame:
    """(by.., r): weighted Pearson correlation from weighted sums; 0 if degenerate."""
    sw, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    cov = F.sum(w * a * b) - sa * sb / sw
    va, vb = F.sum(w * a * a) - sa * sa / sw, F.sum(w * b * b) - sb * sb / sw
    return rows.groupBy(*by).agg(F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb)).otherwise(F.lit(0.0)).alias("r"))


def _wcorr(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    ma, mb = np.average(a, weights=w), np.average(b, weights=w)
    va, vb = np.average((a - ma) ** 2, weights=w), np.average((b - mb) ** 2, weights=w)
    return float(np.average((a - ma) * (b - mb), weights=w) / np.sqrt(va * vb)) if va > 1e-12 and vb > 1e-12 else 0.0


def _falling(x: np.ndarray) -> np.ndarray:
    """1 / rank of each value, the largest first; of equal ones the first."""
    return 1 / (np.argsort(np.argsort(-x, kind="stable"), kind="stable") + 1.0)


def vertical(scores: np.ndarray) -> list[int]:
    """Columns that raise the weighted correlation of their mean with the mean of all; points weigh 1 / rank.

    The next column to try is the one that correlates most with the mean of those taken, points weighed by their ranks there.
    """
    unified = _unified(scores)
    goal = unified.mean(axis=1)
    weight = _falling(goal)
    taken = [int(np.argmax([_wcorr(unified[:, i], goal, weight) for i in range(unified.shape[1])]))]
    left = [i for i in range(unified.shape[1]) if i != taken[0]]
    best = _wcorr(unified[:, taken[0]], goal, weight)
    while left:
        current = unified[:, taken].mean(axis=1)
        near = _falling(current)
        i = left.pop(int(np.argmax([_wcorr(unified[:, j], current, near) for j in left])))
        value = _wcorr(unified[:, [*taken, i]].mean(axis=1), goal, weight)
        if value > best:
            taken.append(i)
            best = value
    return sorted(taken)


def _unified(scores: np.ndarray) -> np.ndarray:
    """Scores above the mean by the error function of their deviation, others 0."""
    mean, std = scores.mean(axis=0), scores.std(axis=0)
    z = (scores - mean) / np.where(std == 0, 1e-12, std)
    return np.vectorize(math.erf, otypes=[float])(np.maximum(z, 0) / math.sqrt(2))


def competition_ranks(scores: np.ndarray) -> np.ndarray:
    """Per column the rank from 1 of each point: one more than the points with higher scores."""
    return len(scores) - np.stack([np.searchsorted(np.sort(c), c, side="right") for c in scores.T], axis=1) + 1


def beta_tails(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per point, for its normalized ranks in rising order, the chance that as many of as many random ranks are as good; and the
    columns in that order. The k-th tail is the sum over l >= k of C(n, l) r^l (1 - r)^(n - l)."""
    r = ranks / len(ranks)
    order = np.argsort(r, axis=1, kind="stable")
    r = np.take_along_axis(r, order, axis=1)
    n = r.shape[1]
    tails = np.zeros_like(r)
    for k in range(1, n + 1):
        x = r[:, k - 1]
        tails[:, k - 1] = sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(k, n + 1))
    return tails, order


def mixture(score: np.ndarray, cut_off: int = 20, rounds: int = 100) -> np.ndarray:
    """Posterior of the outlier class in a mixture of an exponential (normal points) and a normal law (outliers), by
    expectation maximization with hard assignments."""
    x = score - score.min()
    if x.max() <= 0:
        return np.zeros(len(x))
    out = x >= np.partition(x, -min(cut_off, len(x)))[-min(cut_off, len(x))]
    p = np.zeros(len(x))
    for _ in range(rounds):
        if not out.any() or out.all():
            break
        rate, mean, std, share = 1 / max(x[~out].mean(), 1e-12), x[out].mean(), max(x[out].std(), 1e-6), out.mean()
        normal = share * np.exp(-0.5 * ((x - mean) / std) ** 2) / (std * np.sqrt(2 * np.pi))
        rest = (1 - share) * rate * np.exp(-rate * x)
        p = normal / np.maximum(normal + rest, 1e-300)
        new = p > 0.5
        if (new == out).all():
            break
        out = new
    return p


def is_outlier(posterior: np.ndarray) -> np.ndarray:
    return posterior > 0.5


def horizontal(scores: np.ndarray, keep: str = "rare") -> list[int]:
    """Columns that rank well what most of them call outliers.

    For each such point the beta tails of its ranks are least at some place; the detectors behind that place rank it badly. Detectors
    are parted into two groups by how often that happens to them, by 2-means from the least and the largest share. The group with
    the lower share is kept; ``keep`` "frequent" keeps the other one, as some implementations do. Without outliers, or without a difference, all stay.
    """
    n = scores.shape[1]
    tags = np.stack([is_outlier(mixture(scores[:, i])) for i in range(n)], axis=1).sum(axis=1)
    hot = np.flatnonzero(tags > n // 2) if n % 2 else np.flatnonzero((tags >= n // 2) & (tags > 0))
    if not len(hot):
        return list(range(n))
    tails, order = beta_tails(competition_ranks(scores))
    place = tails[hot].argmin(axis=1)
    behind = np.arange(n) > place[:, None]
    share = np.bincount(order[hot][behind], minlength=n) / len(hot)
    low, high = float(share.min()), float(share.max())
    if low == high:
        return list(range(n))
    while True:
        near = np.abs(share - low) <= np.abs(share - high)
        centres = float(share[near].mean()), float(share[~near].mean())
        if centres == (low, high):
            return np.flatnonzero(near if keep == "rare" else ~near).tolist()
        low, high = centres


CONSENSUS = ("inverse-ranking", "robust-ranking", "mixture-mean", "mixture-max", "unification-mean", "unification-max", "kemeny")
#: Points of the longest series that the Kemeny consensus, quadratic at worst, takes part for.
MOST_KEMENY = 100_000


def kemeny_scores(ranks: np.ndarray, passes: int = 100) -> np.ndarray:
    """Scores of an approximate Kemeny order: points by the pairs they win over all voters, then neighbours that a majority has the
    other way round change places, at most ``passes`` times over. Pairs are counted by sorting, not one by one."""
    n = len(ranks)
    wins = sum(n - np.searchsorted(np.sort(c), c, side="right") for c in ranks.T)
    order = np.argsort(-wins, kind="stable")
    for turn in range(2 * passes):
        first = order[turn % 2 : n - 1 : 2]
        second = order[turn % 2 + 1 : n : 2]
        swap = (ranks[second] < ranks[first]).sum(axis=1) > (ranks[first] < ranks[second]).sum(axis=1)
        if turn and not swap.any() and not moved:
            break
        moved = swap.any()
        order[turn % 2 : n - 1 : 2], order[turn % 2 + 1 : n : 2] = np.where(swap, second, first), np.where(swap, first, second)
    out = np.empty(n)
    out[order] = np.arange(n, 0, -1)
    return out


def consensus(scores: np.ndarray) -> np.ndarray:
    """The consensus scores of ``CONSENSUS`` side by side, the last one only for series that aren't too long for it."""
    posterior = np.stack([mixture(scores[:, i]) for i in range(scores.shape[1])], axis=1)
    unified, rank = _unified(scores), competition_ranks(scores)
    columns = [(1 / rank).mean(axis=1), 1 - beta_tails(rank)[0].min(axis=1), posterior.mean(axis=1), posterior.max(axis=1), unified.mean(axis=1), unified.max(axis=1)]
    if len(scores) < MOST_KEMENY:
        columns.append(kemeny_scores(rank))
    return np.stack(columns, axis=1)


def select_ensemble(scores: np.ndarray, strategy: str = "vertical") -> np.ndarray:
    """Select detectors, build consensuses, select among those, join the rest by inverse ranks: scores 1 / rank.

    The order of the detectors doesn't matter. If one is selected, its ranks are the result.
    """
    if scores.size > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values")
    choose = {"vertical": vertical, "horizontal": horizontal}[strategy]
    chosen = scores[:, choose(scores)]
    if chosen.shape[1] == 1:
        return 1 / competition_ranks(chosen)[:, 0]
    both = consensus(chosen)
    chosen = np.round(both[:, choose(both)], 12)  # sums of the same numbers in another order are equal
    mean = np.round((1 / competition_ranks(chosen)).mean(axis=1), 12)
    behind = len(mean) - np.searchsorted(np.sort(mean), mean, side="left")  # ties take the largest rank
    return 1 / behind


def select_series(scores: DataFrame, by: list[str], strategy: str = "vertical") -> DataFrame:
    """(by.., t, score) of the selective ensemble per series."""
    import pandas as pd

    good = sc.finite_instances(scores, by)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="t", columns="instance", values="score").sort_index().sort_index(axis=1)
        return pd.DataFrame({**dict(zip(by, key, strict=True)), "t": wide.index, "score": select_ensemble(wide.to_numpy(float), strategy)})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.select(*by).schema)
    return good.select(*by, "instance", "t", "score").groupBy(*by).applyInPandas(run, f"{keys}, t bigint, score double")


def unified_frame(scores: DataFrame, by: list[str]) -> DataFrame:
    """Unification by the error function, as a frame."""
    return sc.gaussian(scores, by)


def normal_tail(z: Column) -> Column:
    return (1 - erf(z / F.lit(2.0**0.5))) / 2


def base_ranks(scores: DataFrame, by: list[str]) -> DataFrame:
    """Ranks from 1 of the finite instances, ties the largest."""
    return rk.max_ranks(sc.finite_instances(scores, by), [*by, "instance"], by)
