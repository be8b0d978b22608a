"""Selective ensembles and exact rank consensus against brute force."""

from __future__ import annotations

import itertools
import math
import time

import numpy as np
import pytest

from tsquorum.operators import ranks, selective
from tsquorum.plans import kernel_queries, registry, series_queries, views  # noqa: F401


def matrix(seed: int, n: int = 200, columns: int = 6) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    y[90:100] = 4
    s = np.abs(np.stack([y * (k < columns - 1) + rng.normal(0, 0.5 + 0.1 * k, n) for k in range(columns)], axis=1))
    s[:5] = s[5:10]  # ties
    return s


def plain_tails(rank: np.ndarray) -> list[list[float]]:
    n, m = rank.shape[1], len(rank)
    out = []
    for row in rank:
        r = sorted(x / m for x in row)
        out.append([sum(math.comb(n, j) * r[k - 1] ** j * (1 - r[k - 1]) ** (n - j) for j in range(k, n + 1)) for k in range(1, n + 1)])
    return out


def test_beta_tails_equal_plain_sums():
    s = matrix(1)
    rank = selective.competition_ranks(s)
    assert [[1 + sum(x > s[i, k] for x in s[:, k]) for k in range(6)] for i in range(200)] == rank.tolist()
    tails, order = selective.beta_tails(rank)
    assert np.allclose(tails, plain_tails(rank))
    assert (np.diff(np.take_along_axis(rank, order, axis=1), axis=1) >= 0).all()
    assert np.allclose(selective.consensus(s)[:, 1], 1 - np.min(plain_tails(rank), axis=1))


def test_horizontal_equals_a_plain_count():
    s = matrix(2)
    tags = np.stack([selective.is_outlier(selective.mixture(s[:, k])) for k in range(6)], axis=1)
    rank = selective.competition_ranks(s)
    points = [i for i in range(200) if tags[i].sum() >= 3]
    count = np.zeros(6)
    for i in points:
        r = sorted((rank[i, k] / 200, k) for k in range(6))
        tails = [sum(math.comb(6, j) * x**j * (1 - x) ** (6 - j) for j in range(k, 7)) for k, (x, _) in enumerate(r, 1)]
        for _, k in r[int(np.argmin(tails)) + 1 :]:
            count[k] += 1
    assert points and count[5] == count.max() and 5 not in selective.horizontal(s)
    both = [selective.horizontal(s, keep) for keep in ("rare", "frequent")]
    assert sorted(both[0] + both[1]) == list(range(6)) and max(count[both[0]]) < min(count[both[1]])
    assert selective.horizontal(np.ones((50, 3))) == [0, 1, 2]


@pytest.mark.parametrize("strategy", ["vertical", "horizontal"])
def test_the_order_of_detectors_does_not_matter(strategy):
    for seed in (3, 4):
        s = matrix(seed)
        whole = selective.select_ensemble(s, strategy)
        for order in ([5, 4, 3, 2, 1, 0], [2, 0, 5, 1, 4, 3]):
            assert np.allclose(selective.select_ensemble(s[:, order], strategy), whole)
        assert whole[90:100].mean() > 5 * whole.mean()


def test_vertical_equals_a_plain_greedy_choice():
    s = matrix(5)
    u = selective._unified(s)
    goal = u.mean(axis=1)
    by_rank = lambda x: np.array([1 / (1 + sum(x > v)) for v in x])
    w = by_rank(goal)
    corr = lambda a, b, w: np.cov(a, b, aweights=w, ddof=0)[0, 1] / math.sqrt(np.cov(a, aweights=w, ddof=0) * np.cov(b, aweights=w, ddof=0))
    first = max(range(6), key=lambda k: corr(u[:, k], goal, w))
    taken, rest = [first], set(range(6)) - {first}
    while rest:
        mean = u[:, taken].mean(axis=1)
        k = max(sorted(rest), key=lambda k: corr(u[:, k], mean, selective._falling(mean)))
        rest.remove(k)
        if corr(u[:, [*taken, k]].mean(axis=1), goal, w) > corr(mean, goal, w):
            taken.append(k)
    assert selective.vertical(s) == sorted(taken)


def test_kemeny_scores_follow_majorities():
    rank = selective.competition_ranks(matrix(6, 40, 5))
    order = np.argsort(-selective.kemeny_scores(rank))
    for a, b in zip(order, order[1:], strict=False):
        assert (rank[a] < rank[b]).sum() >= (rank[b] < rank[a]).sum()


def test_exact_orders_beyond_sixteen_items():
    rng = np.random.default_rng(7)
    for n in (3, 7, 8):
        items = [f"i{k}" for k in range(n)]
        votes = {(a, b): int(rng.integers(0, 3)) for a in items for b in items if a != b}
        score = lambda o: sum(votes[a, b] for a, b in itertools.combinations(o, 2))  # noqa: E731, B023
        assert ranks.kemeny_exact(votes, items) == list(max(itertools.permutations(items), key=score))
    # 60 items in twelve tangled groups of five, each group beating the next
    items = [f"{k:02d}" for k in range(60)]
    votes = {}
    for a, b in itertools.permutations(range(60), 2):
        votes[items[a], items[b]] = int(rng.integers(1, 10)) if a // 5 == b // 5 else 9 * (a // 5 < b // 5)
    begin = time.process_time()
    order = ranks.kemeny_exact(votes, items[::-1])
    assert time.process_time() - begin < 5
    for g in range(12):
        inside = items[5 * g : 5 * g + 5]
        best = max(itertools.permutations(inside), key=lambda o: sum(votes[a, b] for a, b in itertools.combinations(o, 2)))
        assert order[5 * g : 5 * g + 5] == list(best)
    # one group of 18: voters around one order
    names = [f"{k:02d}" for k in range(18)]
    ballots = [sorted(range(18), key=lambda k: k + rng.normal(0, 6)) for _ in range(9)]
    votes = {(names[a], names[b]): sum(o.index(a) < o.index(b) for o in ballots) for a, b in itertools.permutations(range(18), 2)}
    cost = lambda o: sum(votes[b, a] for a, b in itertools.combinations(o, 2))
    best = ranks.kemeny_exact(votes, names)
    assert all(cost(best) <= cost([names[k] for k in o]) for o in ballots)
    for k in range(17):
        assert cost(best) <= cost([*best[:k], best[k + 1], best[k], *best[k + 2 :]])
    tangled = {(a, b): float(rng.integers(0, 2)) for a in names for b in names if a != b}
    with pytest.raises(ValueError, match="tangled"):
        ranks.kemeny_exact(tangled, names, most=20)


def test_queries_of_consensus(spark, sf_dir):
    votes: dict = {}
    for g, voter, item, rank in series_queries._votes(spark, sf_dir).select("g", "voter", "item", "rank").collect():
        votes.setdefault(g, {}).setdefault(voter, {})[item] = rank
    got: dict = {}
    for r in registry.QUERIES["r12_kemeny_best"](spark, sf_dir).orderBy("g", "rank").collect():
        got.setdefault(r["g"], []).append(r["item"])
    assert got.keys() == votes.keys()
    for g, ballots in votes.items():
        score = lambda o: sum(b[x] < b[y] for b in ballots.values() for x, y in itertools.combinations(o, 2))  # noqa: E731, B023
        assert score(got[g]) == max(map(score, itertools.permutations(sorted(got[g]))))
    wide: dict = {}
    for s, instance, t, score in views.user_scores(spark, sf_dir).select("series_id", "instance", "t", "score").collect():
        wide.setdefault(s, {}).setdefault(instance, {})[t] = score
    found = {(r["series_id"], r["t"]): r["score"] for r in registry.QUERIES["b7_selective_ensemble"](spark, sf_dir).collect()}
    for s in sorted(wide)[:5]:
        m = np.array([[wide[s][i][t] for i in sorted(wide[s])[::-1]] for t in sorted(wide[s][sorted(wide[s])[0]])])
        assert np.allclose([found[s, t] for t in range(len(m))], selective.select_ensemble(m), atol=1e-6)
