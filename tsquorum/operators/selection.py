"""Selection of detector instances. Candidates are (instance, no_datasets, mean_train_quality): tens of rows.

Orders and clusterings are DataFrame plans where they can be; greedy methods loop on the driver over the matrix of
distances between instances, whose size is the number of candidates squared and doesn't depend on the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsquorum.operators import ranks
from tsquorum.operators.distances import DISTANCES

#: More candidates than this don't go through a driver loop; their distances are half a million numbers there.
MOST_CANDIDATES = 1000


def by_coverage(candidates: DataFrame) -> DataFrame:
    """Most covered training series first, then better quality, then name: adds rank from 0."""
    return _ranked(candidates, F.col("no_datasets").desc(), F.col("mean_train_quality").desc())


def by_quality(candidates: DataFrame) -> DataFrame:
    return _ranked(candidates, F.col("mean_train_quality").desc())


def by_result(candidates: DataFrame) -> DataFrame:
    """By the mean of min-max scaled coverage and quality; a constant one counts 0."""
    whole = Window.partitionBy()
    scaled = []
    for c in ("no_datasets", "mean_train_quality"):
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        scaled.append(F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0)))
    return _ranked(candidates.withColumn("combined", (scaled[0] + scaled[1]) / 2), F.col("combined").desc())


def _ranked(candidates: DataFrame, *order) -> DataFrame:
    return candidates.withColumn("rank", (F.row_number().over(Window.partitionBy().orderBy(*order, "instance")) - 1).cast("long"))


def top_k(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.orderBy("rank").limit(k)


class Matrix:
    """Distances between candidates on the driver, candidates in order of coverage."""

    def __init__(self, candidates: DataFrame, distances: DataFrame) -> None:
        rows = by_coverage(candidates).orderBy("rank").limit(MOST_CANDIDATES + 1).collect()
        if len(rows) > MOST_CANDIDATES:
            raise ValueError(f"more than {MOST_CANDIDATES} candidates")
        self.names = [r["instance"] for r in rows]
        self.quality = np.array([r["mean_train_quality"] or 0.0 for r in rows])
        self.coverage = np.array([r["no_datasets"] or 0 for r in rows], float)
        place = {n: i for i, n in enumerate(self.names)}
        self.d = np.zeros((len(rows), len(rows)))
        found = distances.where(F.col("i").isin(self.names) & F.col("j").isin(self.names)).groupBy("i", "j").agg(F.avg("d").alias("d")).toArrow()
        at = [np.array([place[n] for n in found.column(c).to_pylist()], int) for c in ("i", "j")]
        self.d[at[0], at[1]] = self.d[at[1], at[0]] = found.column("d").to_numpy()


def greedy_farthest(m: Matrix, k: int) -> list[str]:
    """From the most covering instance on, always the one with the largest mean distance to those taken."""
    taken = [0] if m.names else []
    while len(taken) < min(k, len(m.names)):
        mean = m.d[:, taken].mean(axis=1)
        mean[taken] = -math.inf
        taken.append(int(mean.argmax()))
    return [m.names[i] for i in taken]


def marginal_quality(m: Matrix, k: int, balance: float = 0.5) -> list[str]:
    """Quality against likeness to those taken: balance * quality - (1 - balance) * max exp(-d^2 / 200)."""
    taken = [int(m.quality.argmax())] if m.names else []
    while len(taken) < min(k, len(m.names)):
        like = np.exp(-(m.d[:, taken] ** 2) / 200).max(axis=1)
        gain = balance * m.quality - (1 - balance) * like
        gain[taken] = -math.inf
        taken.append(int(gain.argmax()))
    return [m.names[i] for i in taken]


def interchange(m: Matrix, k: int, last: int = 20, gap: float = 3.0) -> list[str]:
    """The k most covering ones; each next candidate replaces the member with the least mean distance if its own is
    larger, until its coverage falls more than ``gap`` behind that of the member it would replace."""
    taken = list(range(min(k, len(m.names))))
    for c in range(len(taken), min(last, len(m.names))):
        mean = np.array([m.d[i, [j for j in taken if j != i]].mean() if len(taken) > 1 else 0.0 for i in taken])
        worst = int(mean.argmin())
        if m.coverage[taken[worst]] - m.coverage[c] > gap:
            break
        rest = [j for p, j in enumerate(taken) if p != worst]
        if m.d[c, rest].mean() > mean[worst] if rest else False:
            taken[worst] = c
    return [m.names[i] for i in taken]


def affinity_propagation(m: Matrix, damping: float = 0.5, rounds: int = 200) -> list[str]:
    """Exemplars by message passing on negative squared distances, preference the median; in order of coverage."""
    n = len(m.names)
    if n < 2:
        return list(m.names)
    s = -(m.d**2)
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]))
    a, r = np.zeros((n, n)), np.zeros((n, n))
    rows = np.arange(n)
    for _ in range(rounds):
        both = a + s
        best = both.argmax(axis=1)
        first = both[rows, best]
        both[rows, best] = -math.inf
        new = s - first[:, None]
        new[rows, best] = s[rows, best] - both.max(axis=1)
        r = damping * r + (1 - damping) * new
        plus = np.maximum(r, 0)
        plus[rows, rows] = r[rows, rows]
        column = plus.sum(axis=0)
        new = np.minimum(0, column[None] - plus)
        new[rows, rows] = column - plus[rows, rows]
        a = damping * a + (1 - damping) * new
    exemplars = np.flatnonzero((a + r)[rows, rows] > 0)
    return [m.names[i] for i in (exemplars if len(exemplars) else [int(m.quality.argmax())])]


def k_medoids(m: Matrix, k: int, seed: int = 1, rounds: int = 100) -> list[str]:
    """Partitioning around medoids with spread-out starts; medoids in order of coverage."""
    n, rng = len(m.names), np.random.default_rng(seed)
    if n <= k:
        return list(m.names)
    medoids = [int(rng.integers(n))]
    while len(medoids) < k:
        near = m.d[:, medoids].min(axis=1) ** 2
        medoids.append(int(rng.choice(n, p=near / near.sum())) if near.sum() > 0 else next(i for i in range(n) if i not in medoids))
    cost = m.d[:, medoids].min(axis=1).sum()
    for _ in range(rounds):
        best = None
        for p in range(k):
            for c in set(range(n)) - set(medoids):
                swapped = [*medoids[:p], c, *medoids[p + 1 :]]
                new = m.d[:, swapped].min(axis=1).sum()
                if new < cost - 1e-12:
                    best, cost = swapped, new
        if best is None:
            break
        medoids = best
    return [m.names[i] for i in sorted(medoids)]


def _listed(ranking: DataFrame) -> list[str]:
    rows = ranking.orderBy("rank").limit(MOST_CANDIDATES + 1).collect()
    if len(rows) > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates")
    return [r["instance"] for r in rows]


#: The rankings that rank aggregation goes over.
AGGREGATED = ("training-coverage", "training-quality", "training-result", "affinity-propagation-clustering", "kmedoids-clustering", "greedy-euclidean", "mmq-euclidean", "interchange-euclidean")


def rankings(candidates: DataFrame, scores: DataFrame, by: list[str], k: int) -> DataFrame:
    """(g, voter, item, rank) of the rankings in AGGREGATED, g being 0; an instance that a voter leaves out takes rank n.

    Scores are gone through once per kind of distance, not once per ranking.
    """
    names = _listed(by_coverage(candidates))
    matrices = {d: Matrix(candidates, DISTANCES[d](scores, by)) for d in dict.fromkeys(LOOPED[m][0] for m in AGGREGATED if m in LOOPED)}
    rows = []
    for voter, method in enumerate(AGGREGATED):
        most = k if "clustering" in method else len(names)
        order = LOOPED[method][1](matrices[LOOPED[method][0]], most) if method in LOOPED else SELECTIONS[method](candidates, scores, by, most)
        place = {n: i for i, n in enumerate(order)}
        rows += [(0, voter, n, place.get(n, len(names))) for n in names]
    return candidates.sparkSession.createDataFrame(rows, "g bigint, voter bigint, item string, rank bigint")


def aggregated(candidates: DataFrame, scores: DataFrame, by: list[str], k: int, method: str = "minimum-influence") -> list[str]:
    voted = rankings(candidates, scores, by, k)
    result = ranks.minimum_influence(voted, ["g"]) if method == "minimum-influence" else ranks.trimmed_borda(voted, ["g"], "influence", k=k)
    return [r["item"] for r in result.orderBy("rank", "item").limit(k).collect()]


#: The methods that loop over a matrix, with its distance.
LOOPED: dict[str, tuple[str, Callable[[Matrix, int], list[str]]]] = {
    "affinity-propagation-clustering": ("euclidean", lambda m, k: affinity_propagation(m)[:k]),
    "kmedoids-clustering": ("euclidean", k_medoids),
    "greedy-euclidean": ("euclidean", greedy_farthest),
    "greedy-annotation-overlap": ("annotation-overlap", greedy_farthest),
    "mmq-euclidean": ("euclidean", marginal_quality),
    "mmq-annotation-overlap": ("annotation-overlap", marginal_quality),
    "interchange-euclidean": ("euclidean", interchange),
    "interchange-annotation-overlap": ("annotation-overlap", interchange),
}


def _looped(distance: str, method: Callable[[Matrix, int], list[str]]) -> Callable:
    return lambda candidates, scores, by, k: method(Matrix(candidates, DISTANCES[distance](scores, by)), k)


SELECTIONS: dict[str, Callable[[DataFrame, DataFrame, list[str], int], list[str]]] = {
    "training-coverage": lambda c, s, by, k: _listed(top_k(by_coverage(c), k)),
    "training-quality": lambda c, s, by, k: _listed(top_k(by_quality(c), k)),
    "training-result": lambda c, s, by, k: _listed(top_k(by_result(c), k)),
    **{name: _looped(*made) for name, made in LOOPED.items()},
    "aggregated-minimum-influence": lambda c, s, by, k: aggregated(c, s, by, k),
    "aggregated-robust-borda": lambda c, s, by, k: aggregated(c, s, by, k, "robust-borda"),
}


def select_instances(candidates: DataFrame, scores: DataFrame, by: list[str], method: str = "training-result", k: int = 6) -> list[str]:
    """The ``k`` best instances by a method of SELECTIONS; blanks and underscores in the name count as hyphens."""
    name = method.lower().replace(" ", "-").replace("_", "-")
    if name not in SELECTIONS:
        raise ValueError(f"no selection method {method!r}")
    known = candidates.limit(MOST_CANDIDATES + 1).collect()
    if len(known) > MOST_CANDIDATES:
        return SELECTIONS[name](candidates, scores, by, min(k, candidates.count()))
    return SELECTIONS[name](candidates.sparkSession.createDataFrame(known, candidates.schema), scores, by, min(k, len(known)))  # worked out once
