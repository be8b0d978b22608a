"""Ranks and rank aggregation: rows (by.., voter, item, rank), ranks from 0 unless said otherwise.

Voters are training series or detectors, and items are detectors, tens to hundreds in a group, whatever the length of the series; a voter ranks an
item once. Kendall distances make a row per pair of items and voter, ``voter_distances`` one per pair of items and pair of voters. Reliabilities
go by counts over pairs of items and different rankings instead; only ``proximity`` compares all different ones with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def max_ranks(scores: DataFrame, keys: list[str], over: list[str] | None = None, value: str = "score") -> DataFrame:
    """Ranks from 1, ties get the largest; inverted against the largest rank within ``over`` (default ``keys``)."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    ranked = scores.withColumn("_r", ties)
    return ranked.withColumn("rank", (F.max("_r").over(Window.partitionBy(*(over if over is not None else keys))) - F.col("_r") + 1).cast("long")).drop("_r")


def rank_scores(ranks: DataFrame) -> DataFrame:
    return ranks.withColumn("score", 1.0 / F.col("rank"))


def _placed(sums: DataFrame, by: list[str], value: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(value, "item")
    return sums.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def borda(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Items by the sum of their ranks, ties by item."""
    return _placed(ranks.groupBy(*by, "item").agg(F.sum("rank").alias("points")), by, "points")


def partial_borda(ranks: DataFrame, by: list[str], k: int) -> DataFrame:
    """Borda of the top ``k``: ranks from ``k`` on count as ``k``; items that nobody has among them take the last rank."""
    sums = ranks.groupBy(*by, "item").agg(F.avg(F.least("rank", F.lit(k))).alias("points"), F.bool_or(F.col("rank") < k).alias("_seen"))
    last = F.count(F.lit(1)).over(Window.partitionBy(*by)) - 1
    return _placed(sums, by, "points").withColumn("rank", F.when(F.col("_seen"), F.col("rank")).otherwise(last).cast("long")).drop("_seen")


def kendall(a: DataFrame, b: DataFrame, keys: list[str], other: list[str] | None = None) -> DataFrame:
    """Pairs of items in a different order in ``a`` and ``b`` (both keys.., item, rank); equal ranks are no inversion."""
    shared = keys if other is None else other
    both = a.select(*keys, "item", F.col("rank").alias("x")).join(b.select(*shared, "item", F.col("rank").alias("y")), [*shared, "item"])
    mates = both.select(*keys, F.col("item").alias("item2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    inverted = (F.col("x") < F.col("x2")) & (F.col("y") > F.col("y2"))
    pairs = both.join(mates, keys)  # the items of one ranking: tens
    return pairs.groupBy(*keys).agg(F.sum(F.when(inverted, 1).otherwise(0)).cast("long").alias("distance"))


def objective(ranks: DataFrame, consensus: DataFrame, by: list[str]) -> DataFrame:
    """Mean Kendall distance of the voters to the consensus."""
    return kendall(ranks, consensus, [*by, "voter"], by).groupBy(*by).agg(F.avg("distance").alias("objective"))


def _ballots(ranks: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by.., voter, ballot), a voter's items and ranks as one array, and (by.., ballot, m, first): the different ballots, the number of
    their voters and the first one. What follows from a ballot and from counts over all of them is worked out once per different one."""
    ballots = ranks.groupBy(*by, "voter").agg(F.array_sort(F.collect_list(F.struct("item", "rank"))).alias("ballot"))
    return ballots, ballots.groupBy(*by, "ballot").agg(F.count(F.lit(1)).alias("m"), F.min("voter").alias("first"))


def _pairs(kinds: DataFrame, by: list[str]) -> DataFrame:
    """(by.., ballot, m, a, b) with items in the order a, b."""
    one = kinds.select(*by, "ballot", "m", F.explode("ballot").alias("_a")).select("*", F.explode("ballot").alias("_b"))
    return one.where("_a.rank < _b.rank").select(*by, "ballot", "m", F.col("_a.item").alias("a"), F.col("_b.item").alias("b"))


def _preferences(kinds: DataFrame, by: list[str]) -> DataFrame:
    """(by.., a, b, n): the number of voters that have a before b, where there are any."""
    return _pairs(kinds, by).groupBy(*by, "a", "b").agg(F.sum("m").alias("n"))


def _influence(kinds: DataFrame, by: list[str]) -> DataFrame:
    """(by.., ballot, first, reliability). Distances to a consensus add up over pairs of items, so with the numbers of voters by pair those
    of all others come from the consensus without the voter and its own pairs; no voter meets another."""
    points = kinds.select(*by, "m", F.explode("ballot").alias("_i")).groupBy(*by, F.col("_i.item").alias("a")).agg(F.sum(F.col("m") * F.col("_i.rank")).alias("_s"))
    voters = kinds.groupBy(*by).agg(F.sum("m").alias("_v"))
    counted = _preferences(kinds, by).join(points, [*by, "a"]).join(points.withColumnsRenamed({"a": "b", "_s": "_t"}), [*by, "b"])
    inverted = F.when(F.struct("_s", "a") > F.struct("_t", "b"), F.col("n")).otherwise(0)
    whole = counted.groupBy(*by).agg(F.sum(inverted).alias("_w"))
    own = F.map_from_entries("ballot")
    mine = kinds.select(*by, "ballot", "first", own.alias("_own")).join(counted, by, "left").withColumns({"_x": F.try_element_at("_own", "a"), "_y": F.try_element_at("_own", "b")})
    without = F.struct(F.col("_s") - F.coalesce("_x", F.lit(0)), "a") > F.struct(F.col("_t") - F.coalesce("_y", F.lit(0)), "b")
    others = F.when(without, F.col("n") - F.when(F.col("_x") < F.col("_y"), 1).otherwise(0)).otherwise(0)
    sums = mine.groupBy(*by, "ballot", "first").agg(F.coalesce(F.sum(others), F.lit(0)).alias("_o")).join(voters.where("_v > 1"), by).join(whole, by, "left")
    change = F.coalesce("_w", F.lit(0)) / F.col("_v") - F.col("_o") / (F.col("_v") - 1)
    return sums.select(*by, "ballot", "first", (-change).alias("reliability"))


def influence(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by.., voter, reliability): how much better the Borda consensus fits all others without this voter, negated."""
    ballots, kinds = _ballots(ranks, by)
    return ballots.join(_influence(kinds, by), [*by, "ballot"]).select(*by, "voter", "reliability")


def minimum_influence(ranks: DataFrame, by: list[str]) -> DataFrame:
    """The ranking of the most reliable voter, ties by voter."""
    found = _influence(_ballots(ranks, by)[1], by)
    best = found.groupBy(*by).agg(F.min(F.struct(-F.col("reliability"), F.col("first").alias("voter"))).alias("_b"))
    return ranks.join(best.select(*by, "_b.voter"), [*by, "voter"], "left_semi")


def voter_distances(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by.., voter, other, distance) for all ordered pairs of different voters."""
    others = ranks.select(*by, F.col("voter").alias("other"), "item", F.col("rank").alias("y"))
    both = ranks.select(*by, "voter", "item", F.col("rank").alias("x")).join(others, [*by, "item"]).where("voter <> other")
    keys = [*by, "voter", "other"]
    mates = both.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"))
    inverted = (F.col("x") < F.col("x2")) & (F.col("y") > F.col("y2"))
    return both.join(mates, keys).groupBy(*keys).agg(F.sum(F.when(inverted, 1).otherwise(0)).cast("long").alias("distance"))


#: Different ballots of a part, and cells of its matrix of pairs of items, that meet another part in one task.
MOST_BALLOTS, MOST_CELLS = 2000, 4_000_000


def _nearest(kinds: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by.., ballot, near): distances to the ``k`` nearest other voters with an item in common, in rising order.

    All pairs of different ballots meet, part by part: a task holds two parts and keeps ``k`` distances per ballot.
    """
    items = kinds.select(*by, F.posexplode("ballot").alias("_p", "_i"))
    sizes = items.groupBy(*by).agg(F.array_sort(F.collect_set("_i.item")).alias("_names"), F.count(F.lit(1)).alias("_c"), F.count_if(F.col("_p") == 0).alias("_k"))
    parts = F.greatest(F.ceil(F.col("_c") * F.size("_names") / MOST_CELLS), F.ceil(F.col("_k") / MOST_BALLOTS))
    own = F.map_from_entries("ballot")
    dense = kinds.join(sizes.select(*by, "_names", parts.alias("_parts")), by).withColumn("_own", own)
    dense = dense.select(*by, "ballot", "m", F.transform("_names", lambda n: F.try_element_at("_own", n).cast("double")).alias("x"), "_parts", F.pmod(F.xxhash64("ballot"), "_parts").alias("_at"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_to")
    left = dense.select(*by, "ballot", "m", "x", F.col("_at").alias("_i"), every.alias("_j"), F.lit(True).alias("_left"))
    right = dense.select(*by, "ballot", "m", "x", every.alias("_i"), F.col("_at").alias("_j"), F.lit(False).alias("_left"))

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.select(*by, "ballot").schema) + ", near array<double>"
    out = to_arrow_schema(StructType.fromDDL(kept))

    def run(rows: pa.Table) -> pa.Table:
        x = np.array(rows.column("x").to_pylist(), float)
        mine = np.array(rows.column("_left"), bool)
        p, q = x[mine], x[~mine]
        if not len(p) or not len(q):
            return out.empty_table()
        before = (p[:, :, None] < p[:, None, :]).reshape(len(p), -1).astype(np.float32)
        behind = (q[:, :, None] > q[:, None, :]).reshape(len(q), -1).astype(np.float32)
        d = before @ behind.T
        shared = (~np.isnan(p)).astype(np.float32) @ (~np.isnan(q)).astype(np.float32).T
        often = np.broadcast_to(rows.column("m").to_numpy()[~mine], d.shape).copy()
        place = {row.tobytes(): n for n, row in enumerate(q)}
        for n, row in enumerate(p):
            if (same := place.get(row.tobytes())) is not None:
                often[n, same] -= 1
        d[(shared == 0) | (often == 0)] = np.inf
        most = min(k, len(q))
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        values, counts = np.take_along_axis(d, near, axis=1), np.minimum(np.take_along_axis(often, near, axis=1), k)
        found = [sorted(v for v, c in zip(vs, cs, strict=True) for _ in range(c) if v < np.inf)[:k] for vs, cs in zip(values.tolist(), counts.tolist(), strict=True)]
        return rows.filter(pa.array(mine)).select([*by, "ballot"]).append_column("near", pa.array(found, pa.list_(pa.float64()))).cast(out)

    met = left.unionByName(right).groupBy(*by, "_i", "_j").applyInArrow(run, kept)
    return met.groupBy(*by, "ballot").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")).where(F.size("near") > 0)


def proximity(ranks: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """Reliability as the inverse of the mean distance to the ``k`` nearest voters."""
    ballots, kinds = _ballots(ranks, by)
    mean = F.aggregate("near", F.lit(0.0), lambda s, d: s + d) / F.size("near")
    found = _nearest(kinds, by, k).select(*by, "ballot", (1 / F.greatest(mean, F.lit(1e-12))).alias("reliability"))
    return ballots.join(found, [*by, "ballot"]).select(*by, "voter", "reliability")


def average_distance(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Reliability as 1 / (1e-6 + mean of the voter's row of distances, its own 0 included).

    A row of distances adds up to the voters that have the voter's pairs of items the other way round; who shares an item with whom
    follows from the different sets of items.
    """
    ballots, kinds = _ballots(ranks, by)
    against = _preferences(kinds, by).select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "n")
    sums = _pairs(kinds, by).join(against, [*by, "a", "b"]).groupBy(*by, "ballot").agg(F.sum("n").alias("_s"))
    sets = kinds.groupBy(*by, F.transform("ballot", lambda i: i["item"]).alias("_items")).agg(F.sum("m").alias("_m"))
    met = sets.select(*by, "_items").join(sets.withColumnRenamed("_items", "_other"), by).where(F.arrays_overlap("_items", "_other"))
    shared = met.groupBy(*by, "_items").agg(F.sum("_m").alias("_n")).where("_n > 1")
    every = kinds.select(*by, "ballot", F.transform("ballot", lambda i: i["item"]).alias("_items")).join(shared, [*by, "_items"]).join(sums, [*by, "ballot"], "left")
    found = every.select(*by, "ballot", (1 / (F.lit(1e-6) + F.coalesce("_s", F.lit(0)) / F.col("_n"))).alias("reliability"))
    return ballots.join(found, [*by, "ballot"]).select(*by, "voter", "reliability")


def trimmed_voters(reliability: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """The reliable voters: the ``top`` ones, or the side of the largest gap whose reliabilities add up to more.

    In one dimension two single-linkage clusters are parted by the largest gap; of equal gaps the first. If all are equal, that is the one
    behind the first voter. Windows go over the different values; each voter meets one row, its group's.
    """
    if top is not None:
        order = Window.partitionBy(*by).orderBy(F.col("reliability").desc(), "voter")
        return reliability.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).select(*by, "voter")
    w = Window.partitionBy(*by).orderBy("reliability")
    values = reliability.groupBy(*by, "reliability").agg(F.count(F.lit(1)).alias("_c"), F.min("voter").alias("_first"))
    gaps = values.withColumn("_gap", F.lead("reliability").over(w) - F.col("reliability"))
    cut = F.max(F.struct("_gap", (-F.col("reliability")).alias("_below"))).over(Window.partitionBy(*by))  # a last value has no gap and is the least
    sided = gaps.withColumn("_cut", cut).select("*", F.col("_cut._gap").isNotNull().alias("_parted"), (-F.col("_cut._below")).alias("_at"))
    high = F.when(F.col("_parted"), F.when(F.col("reliability") > F.col("_at"), F.col("_c")).otherwise(0)).otherwise(F.greatest(F.col("_c") - 1, F.lit(1)))
    low = F.when(F.col("_parted"), F.when(F.col("reliability") > F.col("_at"), 0).otherwise(F.col("_c"))).otherwise(F.least(F.col("_c") - 1, F.lit(1)))
    sums = sided.groupBy(*by).agg(F.sum(F.col("reliability") * high).alias("_up"), F.sum(F.col("reliability") * low).alias("_down"), F.bool_and("_parted").alias("_parted"), F.max("_at").alias("_at"), F.sum("_c").alias("_all"), F.min("_first").alias("_first"))
    upper = F.when(F.col("_parted"), F.col("reliability") > F.col("_at")).otherwise((F.col("voter") != F.col("_first")) | (F.col("_all") == 1))
    return reliability.join(sums, by).where(upper == (F.col("_up") >= F.col("_down"))).select(*by, "voter")


RELIABILITIES = {"influence": influence, "proximity": proximity, "averagedistance": average_distance}


def trimmed_borda(ranks: DataFrame, by: list[str], metric: str = "influence", top: int | None = None, k: int | None = None) -> DataFrame:
    """Borda, or its top-``k`` form, of the reliable voters alone."""
    kept = ranks.join(trimmed_voters(RELIABILITIES[metric](ranks, by), by, top), [*by, "voter"], "left_semi")
    return borda(kept, by) if k is None else partial_borda(kept, by, k)


def kemeny(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Approximate Kemeny-Young: items by the number of pairwise losses over all voters, ties by item."""
    mates = ranks.select(*by, "voter", F.col("item").alias("item2"), F.col("rank").alias("r2"))
    lost = F.sum(F.when(F.col("rank") > F.col("r2"), 1).otherwise(0)).cast("long")
    return _placed(ranks.join(mates, [*by, "voter"]).groupBy(*by, "item").agg(lost.alias("points")), by, "points")


def _components(wins: list[list[float]]) -> list[list[int]]:
    """Strongly connected components of "not beaten by", in the order in which they beat each other."""
    n = len(wins)
    reach = [sum(1 << j for j in range(n) if j != i and wins[i][j] >= wins[j][i]) | 1 << i for i in range(n)]
    for k in range(n):
        for i in range(n):
            if reach[i] >> k & 1:
                reach[i] |= reach[k]
    together: dict[int, list[int]] = {}
    for i in range(n):
        together.setdefault(sum(1 << j for j in range(n) if reach[i] >> j & 1 and reach[j] >> i & 1), []).append(i)
    return sorted(together.values(), key=lambda c: -reach[c[0]].bit_count())


def _best_order(wins: list[list[float]], inside: list[int], most: int) -> list[int]:
    """The order of ``inside`` with the fewest disagreements, the first one among equals, by branch and bound.

    Prefixes grow item by item. One is given up if a prefix of the same items was as cheap before, or if its cost and, for each pair of the
    rest, the smaller number of votes exceed the best order known, at first that by wins, improved by moving single items.
    """
    cost = lambda order: sum(wins[b][a] for k, a in enumerate(order) for b in order[k + 1 :])
    known = sorted(inside, key=lambda i: -sum(wins[i][j] for j in inside))
    bound, better = cost(known), True
    while better:
        better = False
        for i in list(known):
            rest = [j for j in known if j != i]
            tries = [[*rest[:k], i, *rest[k:]] for k in range(len(known))]
            found = min(tries, key=cost)
            if (c := cost(found)) < bound - 1e-12:
                known, bound, better = found, c, True
    least = {(i, j): min(wins[i][j], wins[j][i]) for i in inside for j in inside}
    floor = sum(least[i, j] for k, i in enumerate(inside) for j in inside[k + 1 :])
    best, result, seen, nodes = bound + 1e-9, known, {}, 0
    against = {i: sum(wins[j][i] for j in inside if j != i) for i in inside}
    # (cost so far, least cost of the rest, prefix, its items as bits); a stack in which the first names come last
    stack = [(0.0, floor, (), 0)]
    while stack:
        spent, left, prefix, mask = stack.pop()
        if spent + left >= best or spent >= seen.get(mask, math.inf) - 1e-12:
            continue
        seen[mask] = spent
        nodes += 1
        if nodes > most:
            raise ValueError(f"more than {most} prefixes; a cycle of {len(inside)} items is too tangled for an exact order")
        rest = [i for i in inside if not mask >> i & 1]
        if not rest:
            best, result = spent - 1e-12, list(prefix)
            continue
        for i in reversed(rest):
            step = against[i] - sum(wins[j][i] for j in prefix)
            stack.append((spent + step, left - sum(least[i, j] for j in rest if j != i), (*prefix, i), mask | 1 << i))
    return result


def kemeny_exact(preferences: dict[tuple[str, str], float], items: list[str], most: int = 2_000_000) -> list[str]:
    """The order with the fewest disagreements, the first in name order among equals.

    Preferences are counts or weights of (better, worse). Groups of items that beat each other in cycles stand together in every best
    order, and the groups in the order in which they win; so only the inside of each group is searched, up to ``most`` prefixes
    of it, beyond which ValueError is raised.
    """
    names = sorted(items)
    wins = [[preferences.get((a, b), 0) for b in names] for a in names]
    return [names[i] for group in _components(wins) for i in (group if len(group) == 1 else _best_order(wins, group, most))]


def kemeny_best(ranks: DataFrame, by: list[str], most: int = 2_000_000) -> DataFrame:
    """(by.., item, rank): exact Kemeny-Young orders. Pairs are counted as joins; a group's items, tens, are ordered in one task."""
    import pandas as pd

    mates = ranks.select(*by, "voter", F.col("item").alias("worse"), F.col("rank").alias("_r"))
    pairs = ranks.join(mates, [*by, "voter"]).where("item <> worse").groupBy(*by, "item", "worse").agg(F.count_if(F.col("rank") < F.col("_r")).alias("votes"))
    alone = ranks.select(*by, "item").distinct().select(*by, "item", F.col("item").alias("worse"), F.lit(0).cast("long").alias("votes"))

    def order(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = sorted(set(rows["item"]))
        place = {x: k for k, x in enumerate(items)}
        wins = {(f"{place[a]:06d}", f"{place[b]:06d}"): float(v) for a, b, v in zip(rows["item"], rows["worse"], rows["votes"], strict=True)}
        best = kemeny_exact(wins, [f"{k:06d}" for k in range(len(items))], most)
        return pd.DataFrame({**{c: [v] * len(items) for c, v in zip(by, key, strict=True)}, "item": [items[int(x)] for x in best], "rank": range(len(items))})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranks.select(*by, "item").schema)
    return pairs.unionByName(alone).groupBy(*by).applyInPandas(order, f"{kinds}, rank bigint")


def inverse_ranking(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Items by the mean of 1 / rank (ranks from 1), the best first; ties get the largest rank, from 1."""
    means = ranks.groupBy(*by, "item").agg(F.avg(1.0 / F.col("rank")).alias("points"))
    behind = F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(F.col("points").desc()).rangeBetween(Window.unboundedPreceding, 0))
    return means.withColumn("rank", behind.cast("long"))


def _beta_term(n: int, k: int, r: Column) -> Column:
    terms = [F.lit(float(math.comb(n, j))) * F.pow(r, F.lit(float(j))) * F.pow(1 - r, F.lit(float(n - j))) for j in range(k, n)]
    return sum(terms[1:], terms[0])


def robust(ranks: DataFrame, by: list[str], n_voters: int) -> DataFrame:
    """Robust rank aggregation over ``n_voters`` voters numbered from 0, ranks from 1: rho is the least binomial tail
    of the normalized ranks, each taken at its voter's place and without the tail's last term; rank from 1."""
    m = F.count(F.lit(1)).over(Window.partitionBy(*by, "voter"))
    normal = ranks.withColumn("_r", F.col("rank") / m)
    tails = F.coalesce(*[F.when(F.col("voter") == k, _beta_term(n_voters, k, F.col("_r"))) for k in range(n_voters)])
    rho = normal.withColumn("_t", tails).groupBy(*by, "item").agg(F.min("_t").alias("rho"))
    order = Window.partitionBy(*by).orderBy("rho", "item")
    return rho.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("score", 1 - F.col("rho"))


def theta_to_phi(theta: Column) -> Column:
    return F.exp(-theta)


def phi_to_theta(phi: Column) -> Column:
    return -F.log(phi)
