"""Masks, slices and cut points.

A mask is rows (by.., t, flag) with t from 0; slices are rows (by.., b, e), half open. A series may be of any
length: all windows are partitioned by ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mask_to_slices(mask: DataFrame, by: list[str], flag: str = "flag") -> DataFrame:
    """Runs of true rows as slices [b, e): consecutive t minus their rank is constant within a run."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("t"))
    runs = mask.where(F.col(flag)).withColumn("_run", F.col("t") - rank)
    return runs.groupBy(*by, "_run").agg(F.min("t").cast("long").alias("b"), (F.max("t") + 1).cast("long").alias("e")).drop("_run")


def slices_to_mask(slices: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """A flag for each t in [0, n): (by.., t, flag). ``lengths`` has n per series. Slices are exploded, not range-joined."""
    points = lengths.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("t"))
    inside = slices.where("e > b").select(*by, F.explode(F.sequence("b", F.col("e") - 1)).alias("t")).distinct().withColumn("_in", F.lit(True))
    return points.join(inside, [*by, "t"], "left").select(*by, "t", F.coalesce("_in", F.lit(False)).alias("flag"))


def invert_slices(slices: DataFrame, by: list[str], lengths: DataFrame | None = None) -> DataFrame:
    """The gaps between slices. With ``lengths`` also those before the first and after the last slice; without,
    the last row wraps around to (end of the last, begin of the first)."""
    w = Window.partitionBy(*by).orderBy("b", "e")
    if lengths is None:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return slices.select(*by, F.col("e").alias("b"), F.coalesce(F.lead("b").over(w), F.first("b").over(whole)).alias("e"))
    inner = slices.join(lengths, by).select(*by, F.col("e").alias("b"), F.coalesce(F.lead("b").over(w), F.col("n")).alias("e"))
    head = lengths.join(slices.groupBy(*by).agg(F.min("b").alias("_first")), by, "left").select(*by, F.lit(0).cast("long").alias("b"), F.coalesce("_first", "n").cast("long").alias("e"))
    return inner.unionByName(head).where("b < e")


def slice_lengths(slices: DataFrame, absolute: bool = True) -> DataFrame:
    n = F.col("e") - F.col("b")
    return slices.withColumn("length", F.abs(n) if absolute else n)


def inside_slices(points: DataFrame, slices: DataFrame, by: list[str], buffer: int = 0) -> DataFrame:
    """Left semi band join: the points within ``buffer`` of a slice, clipped at 0. Equal keys first, then the range."""
    s = slices.select(*[F.col(k).alias(f"_{k}") for k in by], F.greatest(F.col("b") - buffer, F.lit(0)).alias("_b"), (F.col("e") + buffer).alias("_e"))
    on = (F.col("t") >= F.col("_b")) & (F.col("t") < F.col("_e"))
    for k in by:
        on &= F.col(k) == F.col(f"_{k}")
    return points.join(s, on, "left_semi")


def remove_slices(points: DataFrame, slices: DataFrame, by: list[str]) -> DataFrame:
    """The points outside all slices, renumbered from 0 in column t; the old place stays as t_orig."""
    gone = slices.where("e > b").select(*by, F.explode(F.sequence("b", F.col("e") - 1)).alias("t"))
    kept = points.join(gone, [*by, "t"], "left_anti")
    return index_mapping(kept.withColumnRenamed("t", "t_orig"), by)


def index_mapping(kept: DataFrame, by: list[str]) -> DataFrame:
    """Adds t, the place among the kept rows, to rows with t_orig; read both ways it maps either index to the other."""
    return kept.withColumn("t", (F.row_number().over(Window.partitionBy(*by).orderBy("t_orig")) - 1).cast("long"))


def cut_points(kept: DataFrame, by: list[str]) -> DataFrame:
    """Places (by.., t) where a removed gap was closed; the first place is none."""
    w = Window.partitionBy(*by).orderBy("t_orig")
    return index_mapping(kept, by).withColumn("_prev", F.lag("t_orig").over(w)).where("t > 0 and _prev <> t_orig - 1").select(*by, "t")


def with_region(points: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Adds the number of the stretch between cut points that a point lies in."""
    marked = points.join(cuts.select(*by, "t", F.lit(1).alias("_cut")), [*by, "t"], "left")
    running = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("region", F.sum(F.coalesce("_cut", F.lit(0))).over(running).cast("long")).drop("_cut")


def longest_first(slices: DataFrame, by: list[str], limit: Column) -> DataFrame:
    """Slices by falling length until ``limit`` points are reached; the last one is shortened to fit."""
    order = Window.partitionBy(*by).orderBy((F.col("e") - F.col("b")).desc(), "b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    running = slices.withColumn("_before", F.coalesce(F.sum(F.col("e") - F.col("b")).over(before), F.lit(0)))
    return running.where(F.col("_before") < limit).select(*by, "b", F.least(F.col("e"), F.col("b") + limit - F.col("_before")).cast("long").alias("e"))


def close_gaps(slices: DataFrame, by: list[str], shorter_than: Column) -> DataFrame:
    """Joins neighbouring slices whose gap is smaller."""
    w = Window.partitionBy(*by).orderBy("b")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = F.coalesce((F.col("b") - F.lag("e").over(w) >= shorter_than).cast("int"), F.lit(1))
    grouped = slices.withColumn("_far", far).withColumn("_group", F.sum("_far").over(running))
    return grouped.groupBy(*by, "_group").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("_group")
