"""Score matrices in long format (by.., instance, t, score): filtering, normalization, thresholds, ensembles.

``by`` names the series; every window is partitioned by series and instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsquorum.functions.scalar import erf, erfinv, finite


def finite_instances(scores: DataFrame, by: list[str]) -> DataFrame:
    """Drops every instance with a null or non-finite score at any point."""
    good = scores.groupBy(*by, "instance").agg(F.bool_and(finite(F.col("score"))).alias("_ok")).where("_ok").drop("_ok")
    return scores.join(good, [*by, "instance"], "left_semi")


def minmax(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Scales each instance to [0, 1]; a constant one becomes 0."""
    w = Window.partitionBy(*by, "instance")
    low, high = F.min(value).over(w), F.max(value).over(w)
    return scores.withColumn(value, (F.col(value) - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)))


def gaussian(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Probability of being an outlier under a normal law, negatives cut to 0; population deviation, 1e-12 if that is 0.

    Scores that start at 0 and exceed 1 are divided by their maximum first, once.
    """
    w = Window.partitionBy(*by, "instance")
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = scores.withColumn("_x", F.when((low == 0) & (high > 1), F.col(value) / high).otherwise(F.col(value)))
    mean, std = F.avg("_x").over(w), F.stddev_pop("_x").over(w)
    z = (F.col("_x") - mean) / (F.when(std == 0, F.lit(1e-12)).otherwise(std) * F.lit(2.0**0.5))
    return scaled.withColumn("_z", z).withColumn(value, F.greatest(erf(F.col("_z")), F.lit(0.0))).drop("_x", "_z")


def gaussian_inverse(probability: Column, mean: Column, std: Column) -> Column:
    """The score with this probability; cut-off negatives don't come back."""
    return erfinv(probability) * std * F.lit(2.0**0.5) + mean


def regularized(scores: DataFrame, by: list[str], mode: str, value: str = "score") -> DataFrame:
    """``inverse-log``, ``inverse-linear`` or ``regular`` (distance above the median).

    Instances with a score that isn't above 0 have no logarithm and are inverted linearly.
    """
    w = Window.partitionBy(*by, "instance")
    x = F.col(value)
    linear = F.max(x).over(w) - x
    new = {
        "inverse-log": F.when(F.min(x).over(w) > 0, -F.log(x / F.max(x).over(w))).otherwise(linear),
        "inverse-linear": linear,
        "regular": F.greatest(x - F.median(x).over(w), F.lit(0.0)),
    }[mode]
    return scores.withColumn(value, new)


# ------------------------------------------------------------------------------------------ thresholds


def sigma_threshold(by: list[str], k: float = 2.0, value: str = "score") -> Column:
    """Mean plus ``k`` population deviations, per instance."""
    w = Window.partitionBy(*by, "instance")
    return F.avg(value).over(w) + F.lit(k) * F.stddev_pop(value).over(w)


def percentile_threshold(by: list[str], q: float = 0.9, value: str = "score") -> Column:
    return F.percentile(F.col(value), F.lit(q)).over(Window.partitionBy(*by, "instance"))


def median_unbiased(scores: DataFrame, keys: list[str], q: float, value: str = "score", name: str = "threshold") -> DataFrame:
    """The median-unbiased quantile (type 8) per key: between the order statistics around (n + 1/3) q + 1/3."""
    good = scores.where(finite(F.col(value)))
    w = Window.partitionBy(*keys)
    placed = good.withColumn("_rn", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    h = F.least(F.greatest((F.col("_n") + F.lit(1 / 3)) * F.lit(q) + F.lit(1 / 3), F.lit(1.0)), F.col("_n").cast("double"))
    placed = placed.withColumn("_h", h).where((F.col("_rn") == F.floor("_h")) | (F.col("_rn") == F.floor("_h") + 1))
    low = F.max(F.when(F.col("_rn") == F.floor("_h"), F.col(value)))
    high = F.max(F.when(F.col("_rn") == F.floor("_h") + 1, F.col(value)))
    part = F.max(F.col("_h") - F.floor("_h"))
    return placed.groupBy(*keys).agg((low + part * (F.coalesce(high, low) - low)).alias(name))


def predicted(scores: DataFrame, threshold: Column, name: str = "predicted") -> DataFrame:
    return scores.withColumn(name, F.col("score") >= threshold)


def top_k_ranges(scores: DataFrame, keys: list[str], k: DataFrame) -> DataFrame:
    """(keys.., threshold): the highest score that, as a threshold, yields at least k ranges; none reaches k: the lowest.

    The number of ranges at a threshold is the number of points above it less the neighbouring pairs above it: each
    point opens a range at its own score and each pair of neighbours joins two at the smaller of theirs. So running
    sums over sorted scores give all counts at once.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    paired = scores.withColumn("_prev", F.lag("score").over(w))
    pair = F.when(F.col("_prev").isNotNull(), F.least("score", "_prev"))
    steps = paired.select(*keys, F.explode(F.array(F.struct(F.col("score").alias("at"), F.lit(1).alias("d")), F.struct(pair.alias("at"), F.lit(-1).alias("d")))).alias("s"))
    per_score = steps.where("s.at is not null").groupBy(*keys, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    down = Window.partitionBy(*keys).orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = per_score.withColumn("_ranges", F.sum("d").over(down)).join(k, keys)
    return counted.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_ranges") >= F.col("k"), F.col("at"))), F.min("at")).alias("threshold"))


# ------------------------------------------------------------------------------------------ ensembles


def combine_max(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by, "t").agg(F.max("score").alias("score"))


def combine_mean(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by, "t").agg(F.avg("score").alias("score"))


def combine_excess(scores: DataFrame, by: list[str], k: float = 2.0) -> DataFrame:
    """Per point the largest excess over the instances' own thresholds: min-max, then score minus threshold where it
    is reached, else 0."""
    scaled = minmax(scores, by).withColumn("_th", sigma_threshold(by, k))
    excess = F.when(F.col("score") >= F.col("_th"), F.col("score") - F.col("_th")).otherwise(F.lit(0.0))
    return scaled.groupBy(*by, "t").agg(F.max(excess).alias("score"))


COMBINATIONS = {"max": combine_max, "mean": combine_mean, "custom": combine_excess}
NORMALIZATIONS = {"minmax": minmax, "gaussian": gaussian}


def combined(scores: DataFrame, by: list[str], normalization: str = "minmax", combination: str = "custom") -> DataFrame:
    """Finite filter, normalization, finite filter again, ensemble."""
    normal = NORMALIZATIONS[normalization](finite_instances(scores, by), by)
    return COMBINATIONS[combination](finite_instances(normal, by), by)


def majority(votes: Column) -> Column:
    """The commonest value, of several the smallest."""
    return F.mode(votes, True)
