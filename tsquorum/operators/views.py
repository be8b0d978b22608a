"""Windowed views of series as arrays, and their reverses onto points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(points: DataFrame, by: list[str], width: int, value: str = "value") -> DataFrame:
    """All windows of ``width`` values with stride 1, per ``by``; series shorter than a window yield none."""
    ahead = Window.partitionBy(*by).orderBy("t").rowsBetween(0, width - 1)
    return points.select(*by, "t", F.collect_list(value).over(ahead).alias("window")).where(F.size("window") == width)


def reverse_sliding(scores: DataFrame, points: DataFrame, by: list[str], width: int) -> DataFrame:
    """Mean over the windows that cover a point; points without any, or with a NaN, get the smallest score.

    ``scores`` has (by.., t, score) per window begin, ``points`` the (by.., t) to fill.
    """
    score = F.when(~F.isnan("score"), F.col("score"))
    joined = points.select(*by, "t").join(scores.select(*by, "t", score.alias("_s")), [*by, "t"], "left")
    back = Window.partitionBy(*by).orderBy("t").rowsBetween(-(width - 1), 0)
    covered = joined.withColumn("_mean", F.avg("_s").over(back)).withColumn("_least", F.min("_s").over(Window.partitionBy(*by)))
    return covered.select(*by, "t", F.coalesce("_mean", "_least").alias("score"))


def tumbling(points: DataFrame, by: list[str], width: int, cuts: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Blocks (by.., block, window) of ``width`` values, the last one padded with zeros; blocks with a cut are left out."""
    entry = F.struct("t", F.col(value).alias("v"))
    blocks = points.groupBy(*by, F.floor(F.col("t") / width).cast("long").alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    values = F.transform("_rows", lambda r: r["v"])
    padded = blocks.select(*by, "block", F.concat(values, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(values))).alias("window"))
    if cuts is None:
        return padded
    cut_blocks = cuts.select(*by, F.floor(F.col("t") / width).cast("long").alias("block")).distinct()
    return padded.join(cut_blocks, [*by, "block"], "left_anti")


def reverse_tumbling(scores: DataFrame, points: DataFrame, by: list[str], width: int, reach: int = 0) -> DataFrame:
    """Each point's mean of ``1 - score`` over its block and the ``reach`` blocks before; without any the least score."""
    spread = scores.select(*by, F.explode(F.sequence(F.col("block"), F.col("block") + reach)).alias("block"), (F.lit(1.0) - F.col("score")).alias("_s"))
    per_block = spread.groupBy(*by, "block").agg(F.avg("_s").alias("_s"))
    joined = points.select(*by, "t", F.floor(F.col("t") / width).cast("long").alias("block")).join(per_block, [*by, "block"], "left")
    return joined.select(*by, "t", F.coalesce("_s", F.min("_s").over(Window.partitionBy(*by))).alias("score"))


def reverse_separated(scores: DataFrame, by: list[str]) -> DataFrame:
    """Non-finite scores become the least finite one or 0, whichever is smaller."""
    ok = ~F.isnan("score") & (F.abs("score") < F.lit(float("inf")))
    good = F.when(ok, F.col("score"))
    least = F.least(F.lit(0.0), F.coalesce(F.min(good).over(Window.partitionBy(*by)), F.lit(0.0)))
    return scores.withColumn("score", F.coalesce(good, least))


def reverse_intervals(scores: DataFrame, points: DataFrame, by: list[str], reduce: str = "avg") -> DataFrame:
    """Any windows (by.., b, e, score) onto points: mean, sum or maximum of the windows that cover a point, else 0."""
    spread = scores.where("e > b").select(*by, "score", F.explode(F.sequence("b", F.col("e") - 1)).alias("t"))
    per_point = spread.groupBy(*by, "t").agg(F.expr(f"{reduce}(CASE WHEN NOT isnan(score) THEN score END)").alias("score"))
    return points.select(*by, "t").join(per_point, [*by, "t"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def moving(value: Column, by: list[str], before: int, after: int) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy("t").rowsBetween(-before, after))


def past_and_future(errors: DataFrame, by: list[str], small: int, large: int, value: str = "error") -> DataFrame:
    """Mean of the next ``small`` errors against mean and deviation of the ``large - 1`` before, as a normal tail score."""
    w = Window.partitionBy(*by).orderBy("t")
    past, future = w.rowsBetween(-(large - 1), -1), w.rowsBetween(0, small - 1)
    stats = errors.select(*by, "t", F.avg(value).over(past).alias("past_mean"), F.stddev_pop(value).over(past).alias("past_std"), F.avg(value).over(future).alias("future_mean"))
    z = F.abs(F.col("future_mean") - F.col("past_mean")) / F.greatest(F.col("past_std"), F.lit(1e-12))
    return stats.withColumn("score", F.coalesce(z, F.lit(0.0)))


def spread_blocks(points: DataFrame, by: list[str], factor: int, value: str) -> DataFrame:
    """Block maxima after padding on the left by ``factor - n % factor`` rows (a full block if it divides)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    place = F.floor((F.col("t") + F.lit(factor) - n % F.lit(factor)) / F.lit(factor)).cast("long")
    return points.withColumn("block", place).groupBy(*by, "block").agg(F.max(value).alias(value))
