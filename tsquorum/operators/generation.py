"""Training-data generation: periods, regimes, cleaning, limits and pruning of base series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsquorum.operators import scores as sc
from tsquorum.operators.slices import close_gaps, index_mapping, invert_slices, mask_to_slices, slices_to_mask


def peak_period(points: DataFrame, by: list[str], reach: int = 100) -> DataFrame:
    """(by.., peaks, period): points above all ``reach`` neighbours on either side, and length over their number."""
    w = Window.partitionBy(*by).orderBy("t")
    peak = (F.col("value") > F.max("value").over(w.rowsBetween(-reach, -1))) & (F.col("value") > F.max("value").over(w.rowsBetween(1, reach)))
    inside = (F.row_number().over(w) > reach) & (F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(w) >= reach)
    marked = points.withColumn("_p", F.coalesce(peak & inside, F.lit(False)))
    counted = marked.groupBy(*by).agg(F.count_if("_p").alias("peaks"), F.count(F.lit(1)).alias("n"))
    return counted.select(*by, "peaks", F.when(F.col("peaks") > 0, F.floor(F.col("n") / F.col("peaks"))).cast("long").alias("period"))


def period_fault(period: Column, n: Column, most: int = 600, repeats: float = 3 / 0.5, share: float = 0.1) -> Column:
    """Why a period can't be used, or null: too long, too short, or too large a part of the series."""
    return F.when(period > most, "too long").when(period < repeats, "too short").when(period >= share * n, "too large a part")


def choose_k(areas: DataFrame, by: list[str], tiny: float = 1e-6, least_change: float = 0.5) -> DataFrame:
    """Number of snippets from (by.., k, area): the first k with almost no area, else 1 if the area never falls by
    much, else the k with the largest relative fall."""
    w = Window.partitionBy(*by).orderBy("k")
    change = areas.withColumn("_c", F.try_divide(F.lag("area").over(w), F.col("area")) - 1)  # no change to an area of 0, whose k is the answer
    agg = change.groupBy(*by).agg(F.min("area").alias("_min"), F.min_by("k", F.struct("area", "k")).alias("_argmin"), F.max("_c").alias("_max"), F.max_by("k", F.struct("_c", -F.col("k"))).alias("_argmax"))
    return agg.select(*by, F.when(F.col("_min") < tiny, F.col("_argmin")).when(F.coalesce("_max", F.lit(0.0)) < least_change, F.lit(1)).otherwise(F.col("_argmax")).cast("long").alias("k"))


def _running_min(rows: np.ndarray, k: int) -> np.ndarray:
    """The least of each ``k`` neighbours in each row, from running minima of blocks of ``k``."""
    n = rows.shape[1]
    blocks = np.pad(rows, ((0, 0), (0, -n % k)), constant_values=np.inf).reshape(len(rows), -1, k)
    ahead = np.minimum.accumulate(blocks, axis=2).reshape(len(rows), -1)[:, :n]
    back = np.minimum.accumulate(blocks[:, :, ::-1], axis=2)[:, :, ::-1].reshape(len(rows), -1)[:, :n]
    return np.minimum(back[:, : n - k + 1], ahead[:, k - 1 :])


def profile_distances(x: np.ndarray, start: int, width: int, share: float = 0.05) -> np.ndarray:
    """Matrix profile distance of the stretch at ``start`` to every stretch of ``width``: alike parts count wherever they are.

    Both stretches are cut into all parts of half the width, z-normalized; of the distances of each part to the
    nearest one of the other stretch, the value at the place ``share`` * 2 * width from below counts.
    """
    half = max(2, width // 2)
    w = np.lib.stride_tricks.sliding_window_view(x, half).astype(float)
    z = (w - w.mean(axis=1, keepdims=True)) / np.maximum(w.std(axis=1, keepdims=True), 1e-12)
    parts, norm = width - half + 1, (z**2).sum(axis=1)
    d = np.sqrt(np.maximum(norm[start : start + parts, None] + norm - 2 * z[start : start + parts] @ z.T, 0))
    near = np.concatenate([_running_min(d, parts).T, np.lib.stride_tricks.sliding_window_view(d.min(axis=0), parts)], axis=1)
    place = min(2 * parts, max(1, int(np.ceil(share * 2 * width)))) - 1
    return np.partition(near, place, axis=1)[:, place]


def snippet_profiles(x: np.ndarray, width: int, k: int) -> tuple[list[int], np.ndarray]:
    """Greedy snippets: non-overlapping subsequences whose distance profiles cover the series best; their profiles."""
    starts = list(range(0, len(x) - width + 1, width))
    profiles = np.stack([profile_distances(x, s, width) for s in starts])
    best, chosen = np.full(profiles.shape[1], np.inf), []
    for _ in range(min(k, len(starts))):
        area = np.minimum(profiles, best).sum(axis=1)
        area[chosen] = np.inf
        chosen.append(int(area.argmin()))
        best = np.minimum(best, profiles[chosen[-1]])
    return [starts[c] for c in chosen], profiles[chosen]


def regimes(profiles: DataFrame, by: list[str], period: int, tolerance: float = 1e-6) -> DataFrame:
    """(by.., regime, b, e): where a snippet's profile is (almost) the smallest, for at least most of a period; gaps
    shorter than a period are closed first. ``profiles`` has (by.., regime, t, distance)."""
    least = F.min("distance").over(Window.partitionBy(*by, "t"))
    mask = profiles.withColumn("flag", F.col("distance") <= least + tolerance)
    strong = mask_to_slices(mask, [*by, "regime"]).where(F.col("e") - F.col("b") > 0.8 * period)
    closed = close_gaps(strong, [*by, "regime"], F.lit(0.95 * period))
    return closed.where(F.col("e") - F.col("b") >= period)


def sampled_regimes(n: int, length: int, overlap: float, most: int, rng: np.random.Generator, tries: int = 500) -> list[tuple[int, int]]:
    """Random stretches of ``length``, by rejection, that overlap by at most ``overlap`` of a length."""
    count = int(min(most, max(1, (n - length * overlap) // ((1 - overlap) * length))))
    taken: list[tuple[int, int]] = []
    for _ in range(tries):
        if len(taken) >= count or n < length:
            break
        b = int(rng.integers(0, n - length + 1))
        if all(min(b + length, e) - max(b, a) <= overlap * length for a, e in taken):
            taken.append((b, b + length))
    return sorted(taken)


#: Pairs of base series of one run that a driver loop goes through.
MOST_PAIRS = 1_000_000


def _few(rows: DataFrame) -> list:
    found = rows.limit(MOST_PAIRS + 1).collect()
    if len(found) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of base series")
    return found


def prune_overlaps(masks: DataFrame, n_points: int, share: float = 0.1) -> list:
    """Base ids that stay: of two masks that share more than a part of all points the one with more coverage goes.

    Pairs are counted per point; the loop that follows sees one row per pair of base series.
    """
    per_point = masks.where("keep").groupBy("t").agg(F.array_sort(F.collect_list("base")).alias("ids"))
    left = per_point.select("ids", F.posexplode("ids").alias("p", "i"))
    pairs = left.select("i", F.explode(F.slice("ids", F.col("p") + 2, F.size("ids"))).alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share * n_points)
    size = {r["base"]: r["n"] for r in masks.where("keep").groupBy("base").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per base series
    gone: set = set()
    for r in _few(pairs.orderBy("i", "j")):
        if r["i"] not in gone and r["j"] not in gone:
            gone.add(r["i"] if size[r["i"]] >= size[r["j"]] else r["j"])
    return [b for b in sorted(size) if b not in gone]


def prune_similar(distances: DataFrame, lengths: dict, periods: dict, limit: float = 0.0005) -> list:
    """Base ids that stay of equally long, almost equal series: the one whose period is rarest."""
    often: dict = {}
    for p in periods.values():
        often[p] = often.get(p, 0) + 1
    gone: set = set()
    for r in _few(distances.orderBy("i", "j")):
        i, j = r["i"], r["j"]
        if i in gone or j in gone or lengths[i] != lengths[j] or r["d"] >= limit * lengths[i]:
            continue
        gone.add(max((i, j), key=lambda b: (often[periods[b]], b)))
    return [b for b in sorted(periods) if b not in gone]


def cleaning_votes(scores: DataFrame, by: list[str], period: Column, quantile: float = 0.9) -> DataFrame:
    """(by.., instance, t, normal): each detector's vote on each point. A detector's vote is all-normal where its scores
    aren't finite, don't vary, or have a mean above a quarter of their range; its threshold is relaxed while it marks
    more regions than half the number of periods."""
    keys = [*by, "instance"]
    stats = scores.groupBy(*keys).agg(
        F.bool_and(sc.finite(F.col("score"))).alias("_finite"), F.avg("score").alias("_mean"), F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    base = sc.median_unbiased(scores, keys, quantile)
    most = stats.join(base, keys).withColumn("k", F.ceil(F.col("_n") / period * 0.5))
    # The lowest threshold from the quantile on that yields at most k regions.
    w = Window.partitionBy(*keys).orderBy("t")
    paired = scores.withColumn("_prev", F.lag("score").over(w))
    pair = F.when(F.col("_prev").isNotNull(), F.least("score", "_prev"))
    steps = paired.select(*keys, F.explode(F.array(F.struct(F.col("score").alias("at"), F.lit(1).alias("d")), F.struct(pair.alias("at"), F.lit(-1).alias("d")))).alias("s"))
    per = steps.where("s.at is not null").groupBy(*keys, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    down = Window.partitionBy(*keys).orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    regions = per.withColumn("_r", F.sum("d").over(down)).join(most.select(*keys, "threshold", "k"), keys)
    relaxed = regions.where((F.col("at") > F.col("threshold")) & (F.col("_r") <= F.col("k"))).groupBy(*keys).agg(F.min("at").alias("_relaxed"))
    at_base = regions.where(F.col("at") > F.col("threshold")).groupBy(*keys).agg(F.min_by("_r", "at").alias("_at_base"))
    final = most.join(relaxed, keys, "left").join(at_base, keys, "left")
    ignore = ~F.col("_finite") | (F.col("_lo") == F.col("_hi")) | (F.col("_mean") > F.col("_lo") + 0.25 * (F.col("_hi") - F.col("_lo")))
    threshold = F.when(F.coalesce("_at_base", F.lit(0)) <= F.col("k"), F.col("threshold")).otherwise(F.coalesce("_relaxed", F.col("_hi")))
    voted = scores.join(final.select(*keys, ignore.alias("_ignore"), threshold.alias("_th")), keys)
    return voted.select(*keys, "t", (F.col("_ignore") | (F.col("score") <= F.col("_th"))).alias("normal"))


def voted_cuts(votes: DataFrame, by: list[str], period: int, share: float = 0.7) -> DataFrame:
    """Slices to cut: points that fewer than ``share`` of the detectors call normal, and islands between cuts that are
    shorter than a period."""
    counted = votes.groupBy(*by, "t").agg((F.sum(F.col("normal").cast("int")) < F.count(F.lit(1)) * share).alias("flag"))
    return close_gaps(mask_to_slices(counted, by), by, F.lit(period))


def length_limit(period: Column, least: int = 2000, periods: int = 10) -> Column:
    return F.greatest(F.lit(least), period * periods)


def least_cuts(regions: np.ndarray, desired: int) -> tuple[int, int]:
    """The subsequence of ``desired`` points with the fewest cuts; of several the middle one."""
    n = len(regions)
    if desired >= n:
        return 0, n
    cuts = regions[desired - 1 :] - regions[: n - desired + 1]
    best = np.flatnonzero(cuts == cuts.min())
    b = int(best[len(best) // 2])
    return b, b + desired


def limited(points: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """The points inside the kept slices."""
    lengths = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return points.join(slices_to_mask(kept, lengths, by).where("flag").select(*by, "t"), [*by, "t"])


def cleaned(points: DataFrame, cuts: DataFrame, by: list[str], limits: DataFrame) -> DataFrame:
    """(by.., t, t_orig, value): the points outside ``cuts``, renumbered; the longest stretches first, up to ``limit`` points.

    ``limits`` has a limit per series; a stretch that crosses it is shortened. Series that are all cut give no rows.
    """
    lengths = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    kept = invert_slices(cuts, by, lengths).join(limits, by)
    order = Window.partitionBy(*by).orderBy((F.col("e") - F.col("b")).desc(), "b")
    before = F.coalesce(F.sum(F.col("e") - F.col("b")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = kept.withColumn("_room", F.col("limit") - before).where("_room > 0")
    chosen = room.select(*by, "b", F.least("e", F.col("b") + F.col("_room")).cast("long").alias("e"))
    found = limited(points, chosen, by).withColumnRenamed("t", "t_orig")
    return index_mapping(found, by).select(*by, "t", "t_orig", "value")


def regime_kernel(points: DataFrame, by: list[str], period_col: str, k: int = 3) -> DataFrame:
    """(by.., regime, t, distance) snippet profiles for many series, one in memory each."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        x, width = rows["value"].to_numpy(float), int(rows[period_col].iloc[0])
        if len(x) < 2 * width or width < 2:
            return pd.DataFrame({c: [] for c in [*by, "regime", "t", "distance"]})
        _, profiles = snippet_profiles(x, width, k)
        parts = [pd.DataFrame({**dict(zip(by, key, strict=True)), "regime": i, "t": np.arange(len(p)), "distance": p}) for i, p in enumerate(profiles)]
        return pd.concat(parts)

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*by).schema)
    return points.select(*by, "t", "value", period_col).groupBy(*by).applyInPandas(run, f"{keys}, regime bigint, t bigint, distance double")
