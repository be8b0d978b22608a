"""Distances between detector instances, from long scores (by.., instance, t, score)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tsquorum.operators.scores import sigma_threshold


#: Instances of a group; a task holds a matrix of their pairs.
MOST_INSTANCES = 5000


def _products(scores: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by.., i, j, v): for every two instances, either way round, the sum over points of their values' product; points where an
    instance has no value count 0.

    The values at a point meet as one array; a task adds the products of its points up to one matrix per group, rows of which are then
    summed over the tasks. So the rows that move are instances times tasks, not pairs times points.
    """
    names = scores.groupBy(*by).agg(F.array_sort(F.collect_set("instance")).alias("names"))
    points = scores.groupBy(*by, "t").agg(F.map_from_entries(F.collect_list(F.struct("instance", value.cast("double")))).alias("_at"))
    dense = points.join(names, by).select(*by, "names", F.transform("names", lambda n: F.coalesce(F.try_element_at("_at", n), F.lit(0.0))).alias("x"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.select(*by).schema)
    order = [*by, "names", "x"]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        listed: dict[tuple, list[str]] = {}
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for n, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(by))), strict=True)):
                rows.setdefault(key, []).append(n)
            for key, at in rows.items():
                part = batch.take(pa.array(at))
                if key not in listed:
                    listed[key] = part.column(len(by))[0].as_py()
                    if len(listed[key]) > MOST_INSTANCES:
                        raise ValueError(f"more than {MOST_INSTANCES} instances in {key}")
                x = part.column(len(by) + 1).flatten().to_numpy().reshape(len(at), -1)
                sums[key] = sums.get(key, 0) + x.T @ x
        for key, matrix in sums.items():
            own = [pa.array([v] * len(matrix), t) for v, t in zip(key, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(listed[key]), pa.array([listed[key]] * len(matrix)), pa.array(list(matrix))], [*by, "i", "names", "row"])

    types = [to_arrow_type(f.dataType) for f in scores.select(*by).schema]
    parts = dense.select(*order).mapInArrow(added, f"{kinds}, i string, names array<string>, row array<double>")
    first = parts.select(*by, "i", "names", F.posexplode("row").alias("at", "v")).groupBy(*by, "i", "at").agg(F.sum("v").alias("v"), F.first("names").alias("names"))
    return first.select(*by, "i", F.get("names", F.col("at")).alias("j"), "v")


def _paired(products: DataFrame, by: list[str]) -> DataFrame:
    """(by.., i, j, xy, xx, yy) for i < j: products of two instances with those of each with itself."""
    own = products.where("i = j").select(*by, "i", F.col("v").alias("_own"))
    pairs = products.where("i < j").withColumnRenamed("v", "xy")
    with_x = pairs.join(own.withColumnRenamed("_own", "xx"), [*by, "i"])
    return with_x.join(own.withColumnsRenamed({"i": "j", "_own": "yy"}), [*by, "j"])


def euclidean(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by.., i, j, d) for i < j."""
    squared = F.col("xx") + F.col("yy") - 2 * F.col("xy")
    return _paired(_products(scores, by, F.col("score")), by).select(*by, "i", "j", F.sqrt(F.greatest(squared, F.lit(0.0))).alias("d"))


def inverse_cosine(scores: DataFrame, by: list[str]) -> DataFrame:
    """1 - cosine; 1 if a vector is all zeros."""
    cosine = F.when(F.col("xx") * F.col("yy") > 0, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(F.lit(0.0))
    return _paired(_products(scores, by, F.col("score")), by).select(*by, "i", "j", (1 - cosine).alias("d"))


def annotation_overlap(scores: DataFrame, by: list[str], threshold: Column | None = None) -> DataFrame:
    """Jaccard distance of the points at or above the threshold (two deviations by default); 0 if either has none."""
    flagged = scores.withColumn("_p", (F.col("score") >= (sigma_threshold(by) if threshold is None else threshold)).cast("int"))
    either = F.col("xx") + F.col("yy") - F.col("xy")
    distance = F.when((F.col("xx") == 0) | (F.col("yy") == 0), F.lit(0.0)).otherwise(1 - F.col("xy") / F.greatest(either, F.lit(1.0)))
    return _paired(_products(flagged, by, F.col("_p")), by).select(*by, "i", "j", distance.alias("d"))


def both_ways(distances: DataFrame) -> DataFrame:
    """Adds the mirrored pairs."""
    return distances.unionByName(distances.withColumnsRenamed({"i": "j", "j": "i"}))


DISTANCES = {"euclidean": euclidean, "cosine": inverse_cosine, "annotation-overlap": annotation_overlap}
