"""Synthetic series: labelled test series of several kinds, and concatenations of beats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _wave(kind: str, n: int, period: float) -> np.ndarray:
    p = 2 * np.pi * np.arange(n) / period
    return {"sine": np.sin(p), "saw": 2 * (p / (2 * np.pi) % 1) - 1, "square": np.sign(np.sin(p)), "sum": np.sin(p) + 0.5 * np.sin(2.7 * p)}[kind]


def generate(kind: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Series 0 (10,000 points, 3 anomalies), 2 (9,050 points, changing regimes), 3 (long waves) and 4 (13 segments)."""
    rng = np.random.default_rng(seed)
    if kind == 0:
        x, places, length = _wave("sine", 10_000, 100), (2_000, 5_200, 8_100), 100
    elif kind == 2:
        x, places, length = np.concatenate([_wave("sine", 4_500, 90), _wave("saw", 4_550, 130)]), (1_500, 6_500), 50
    elif kind == 3:
        x, places, length = _wave("sum", 10_000, 250), (3_000, 7_000), 120
    elif kind == 4:
        parts = [_wave(("sine", "square", "saw", "sum")[i % 4], 1_000, 50 + 10 * (i % 3)) for i in range(13)]
        x, places, length = np.concatenate(parts), (2_400, 6_300, 10_600), 80
    else:
        raise ValueError(f"no series {kind}")
    x = x + rng.normal(0, 0.05, len(x))
    y = np.zeros(len(x), bool)
    for i, at in enumerate(places):
        x[at : at + length] = (x[at : at + length][::-1], x[at : at + length] * 0.3, x[at : at + length] + 1.5)[i % 3]
        y[at : at + length] = True
    return x, y


def frame(spark: SparkSession, kinds: tuple[int, ...] = (0, 2, 3, 4)) -> DataFrame:
    """The generated series, made on the executors: (series_id, t, value, is_anomaly)."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = generate(int(key[0]))
        return pd.DataFrame({"series_id": f"gt-{key[0]}", "t": np.arange(len(x)), "value": x, "is_anomaly": y})

    ids = spark.createDataFrame([(k,) for k in kinds], "kind bigint")
    return ids.groupBy("kind").applyInPandas(run, "series_id string, t bigint, value double, is_anomaly boolean")


def without_close(annotations: DataFrame, by: list[str], gap: int = 150) -> DataFrame:
    """Annotations (by.., t) whose predecessor is further away than ``gap``."""
    prev = F.lag("t").over(Window.partitionBy(*by).orderBy("t"))
    return annotations.withColumn("_p", prev).where(F.col("_p").isNull() | (F.col("t") - F.col("_p") > gap)).drop("_p")


def concatenated(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by.., t, ..): parts (by.., part, t, ..) one after the other, renumbered."""
    size = parts.groupBy(*by, "part").agg((F.max("t") + 1).alias("_n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = size.select(*by, "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return parts.join(offset, [*by, "part"]).withColumn("t", F.col("t") + F.col("_o")).drop("_o", "part")
