"""Nearest neighbours within long series, or among many vectors, over many tasks.

What is compared is cut into parts: a series into stretches with a halo (a part has all points of the windows that begin in it), vectors by a hash
of their id. Every two parts of a group meet in a task of their own, a tile, which keeps the k nearest of each window in the other part, in both
directions. A window's heaps from all tiles are then merged, in chunks of bounded size. So no task holds more than two parts, or one chunk's heaps; the work
is quadratic in a group's size, as the measure is, but spread over (parts^2 / 2) tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows or vectors of a part, and those whose heaps are merged together.
PART, CHUNK = 4096, 1024
#: Cells of a block of distances.
CELLS = 4_000_000


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*names).schema)


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    if p == 2:
        return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1), 0))
    return np.stack([(np.abs(b - row) ** p).sum(axis=1) ** (1 / p) for row in a])


def normalized_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of z-normalized rows; constant ones are 0 apart from each other, sqrt(length) from others."""
    m = a.shape[1]
    (za, fa), (zb, fb) = _normal(a), _normal(b)
    d = np.sqrt(np.maximum(2 * m * (1 - np.clip(za @ zb.T / m, -1, 1)), 0))
    return np.where(fa[:, None] & fb, 0.0, np.where(fa[:, None] | fb, np.sqrt(m), d))


def _normal(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    std = w.std(axis=1, keepdims=True)
    flat = std[:, 0] < 1e-12
    return (w - w.mean(axis=1, keepdims=True)) / np.where(std < 1e-12, 1.0, std), flat


def _nearest(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances of each row and whose they are, padded with infinity and -1; of equal ones the smaller id."""
    n = min(k, d.shape[1])
    near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.broadcast_to(np.arange(n), (len(d), n))
    got, own = np.take_along_axis(d, near, axis=1), ids[near]
    order = np.lexsort((own, got), axis=1)
    got, own = np.take_along_axis(got, order, axis=1), np.take_along_axis(own, order, axis=1)
    own = np.where(np.isfinite(got), own, -1)
    pad = ((0, 0), (0, k - n))
    return np.pad(got, pad, constant_values=np.inf), np.pad(own, pad, constant_values=-1)


def _tile(one: tuple, two: tuple | None, measure: Callable, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Heaps (distances, ids) of the rows of ``one`` in ``two`` and the reverse; of ``one`` in itself if ``two`` is None.

    Both are (ids, rows, apart): rows whose ids are at most ``apart`` from each other aren't compared.
    """
    (ids, a, apart), (others, b, _) = one, two or one
    heaps, back, step = [], None, max(1, CELLS // max(1, len(b)))
    for lo in range(0, len(a), step):
        part = slice(lo, lo + step)
        d = measure(a[part], b)
        d[np.abs(ids[part, None] - others) <= apart] = np.inf
        heaps.append(_nearest(others, d, k))
        if two is not None:
            more = _nearest(ids[part], d.T, k)
            if back is not None:
                d2, i2 = np.hstack([back[0], more[0]]), np.hstack([back[1], more[1]])
                order = np.lexsort((i2, d2), axis=1)[:, :k]
                more = np.take_along_axis(d2, order, axis=1), np.take_along_axis(i2, order, axis=1)
            back = more
    first = tuple(np.vstack(x) for x in zip(*heaps, strict=True))
    return [first] if two is None else [first, back]


def _met(parts: DataFrame, by: list[str], opened: Callable, measure: Callable, k: int) -> DataFrame:
    """(by.., id, others, distances) from parts (by.., part, parts, ..), which ``opened`` turns into (ids, rows, apart)."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("_other")
    spread = parts.select("*", other).withColumns({"_a": F.least("part", "_other"), "_b": F.greatest("part", "_other")})
    names = [*by, "part", "chunk", "ids", "others", "distances"]

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks = [(int(r["part"]), opened(r)) for r in rows.sort_values("part").to_dict("records")]
        if len(blocks) == 1 and key[-2] != key[-1]:  # by chance the other part is empty
            return pd.DataFrame(columns=names)
        heaps = _tile(blocks[0][1], blocks[1][1] if len(blocks) > 1 else None, measure, k)
        out = []
        for (part, (ids, _, _)), (d, i) in zip(blocks, heaps, strict=True):
            for c in range(-(-len(ids) // CHUNK)):
                some = slice(c * CHUNK, (c + 1) * CHUNK)
                out.append((*key[: len(by)], part, c, ids[some], i[some].ravel(), d[some].ravel()))
        return pd.DataFrame(out, columns=names)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["ids"].iloc[0]
        d, i = (np.hstack([np.asarray(x).reshape(len(ids), k) for x in rows[c]]) for c in ("distances", "others"))
        order = np.lexsort((i, d), axis=1)[:, :k]
        d, i = np.take_along_axis(d, order, axis=1), np.take_along_axis(i, order, axis=1)
        keep = [np.isfinite(row) for row in d]
        return pd.DataFrame({**{c: [v] * len(ids) for c, v in zip(by, key, strict=False)}, "id": ids, "others": [x[m] for x, m in zip(i, keep, strict=True)], "distances": [x[m] for x, m in zip(d, keep, strict=True)]})

    kinds = _fields(parts, by)
    met = spread.groupBy(*by, "_a", "_b").applyInPandas(tile, f"{kinds}part bigint, chunk bigint, ids array<bigint>, others array<bigint>, distances array<double>")
    return met.groupBy(*by, "part", "chunk").applyInPandas(merge, f"{kinds}id bigint, others array<bigint>, distances array<double>")


def _series_parts(points: DataFrame, by: list[str], width, length: int) -> DataFrame:
    """(by.., part, parts, n, m, values): stretches of ``length`` window starts with the points of their windows; ``width`` is a column of n."""
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("m", width.cast("long")).where("m >= 1 and n > m")
    sized = points.select(*by, "t", "value").join(sizes, by)
    first = F.floor(F.greatest(F.lit(0), F.col("t") - F.col("m") + 1) / length).cast("long")
    last = F.floor(F.least(F.col("t"), F.col("n") - F.col("m")) / length).cast("long")
    dealt = sized.withColumn("part", F.explode(F.sequence(first, last)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda p: p["value"])
    parts = F.ceil((F.first("n") - F.first("m") + 1) / length).cast("long")
    return dealt.groupBy(*by, "part").agg(parts.alias("parts"), F.first("n").alias("n"), F.first("m").alias("m"), listed.alias("values"))


def nearest_windows(points: DataFrame, by: list[str], width, k: int, *, p: float = 2, apart: Callable[[int], int] | None = None, normalized: bool = False, length: int = PART) -> DataFrame:
    """(by.., id: where a window begins, others, distances): the ``k`` nearest other windows in the same series (by.., t from 0 without gaps, value).

    ``width`` is a column that may use ``n``, the number of points. Windows that begin at most ``apart`` (a function of the width; None: 0) from each other aren't compared.
    ``normalized`` compares z-normalized windows. Series with fewer than two windows give no rows; windows without a partner get empty arrays.
    """

    def opened(row: dict) -> tuple[np.ndarray, np.ndarray, int]:
        m = int(row["m"])
        w = np.lib.stride_tricks.sliding_window_view(np.asarray(row["values"], float), m)
        return row["part"] * length + np.arange(len(w)), w, apart(m) if apart else 0

    return _met(_series_parts(points, by, width, length), by, opened, normalized_distances if normalized else lambda a, b: distances(a, b, p), k)


def window_means(scored: DataFrame, points: DataFrame, by: list[str], width, length: int = PART) -> DataFrame:
    """(by.., t, score): per point the mean score of the windows (by.., id, score) that cover it, 0 where none does; in parts of the series."""
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("m", width.cast("long"))
    wide = scored.join(sizes, by)
    last = F.floor(F.least(F.col("id") + F.col("m") - 1, F.col("n") - 1) / length).cast("long")
    near = wide.withColumn("_part", F.explode(F.sequence(F.floor(F.col("id") / length).cast("long"), last))).select(*by, "_part", "m", "id", "score")
    own = points.select(*by, F.floor(F.col("t") / length).cast("long").alias("_part"), "t")
    names = [*by, "t", "score"]

    def mean(key: tuple, at: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        if at.empty:
            return pd.DataFrame(columns=names)
        t = np.sort(at["t"].to_numpy())
        total, count = np.zeros(len(t) + 1), np.zeros(len(t) + 1)
        if len(windows):
            lo = np.searchsorted(t, windows["id"].to_numpy(), "left")
            hi = np.searchsorted(t, windows["id"].to_numpy() + windows["m"].to_numpy(), "left")
            for sign, place in ((1, lo), (-1, hi)):
                np.add.at(total, place, sign * windows["score"].to_numpy())
                np.add.at(count, place, sign)
        total, count = np.cumsum(total)[:-1], np.cumsum(count)[:-1]
        return pd.DataFrame({**{c: [v] * len(t) for c, v in zip(by, key, strict=False)}, "t": t, "score": np.where(count > 0, total / np.maximum(count, 1), 0.0)})

    return own.groupBy(*by, "_part").cogroup(near.groupBy(*by, "_part")).applyInPandas(mean, f"{_fields(points, by)}t bigint, score double")


def knn_scores(points: DataFrame, by: list[str], window: int, k: int, method: str = "largest", p: float = 2, length: int = PART) -> DataFrame:
    """The scores of the ``subsequence_knn`` detector for series of any length, over many tasks."""
    width = F.least(F.lit(window), F.col("n"))
    near = nearest_windows(points, by, width, k, p=p, length=length)
    d = F.col("distances")
    middle = F.floor((F.size(d) - 1) / 2).cast("int")
    value = {
        "largest": F.array_max(d), "mean": F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d),
        "median": (F.get(d, middle) + F.get(d, F.floor(F.size(d) / 2).cast("int"))) / 2,
    }[method]
    return window_means(near.select(*by, "id", value.alias("score")), points, by, width, length)


def profile_scores(points: DataFrame, by: list[str], window: int, length: int = PART) -> DataFrame:
    """The scores of the ``stomp`` detector (z-normalized distance to the nearest window not close by), over many tasks."""
    width = F.greatest(F.lit(3), F.least(F.lit(window).cast("long"), F.floor(F.col("n") / 2)))
    near = nearest_windows(points, by, width, 1, normalized=True, apart=lambda m: max(1, m // 4), length=length)
    return window_means(near.select(*by, "id", F.coalesce(F.get("distances", F.lit(0)), F.lit(0.0)).alias("score")), points, by, width, length)


def lof_scores(points: DataFrame, by: list[str], window: int, k: int, p: float = 2, length: int = PART) -> DataFrame:
    """The scores of the ``subsequence_lof`` detector, over many tasks: reachabilities and densities are joins of the neighbours."""
    width = F.least(F.lit(window), F.col("n"))
    near = nearest_windows(points, by, width, k, p=p, length=length)
    edges = near.select(*by, "id", F.explode(F.arrays_zip("others", "distances")).alias("e")).select(*by, "id", F.col("e.others").alias("other"), F.col("e.distances").alias("d"))
    radius = near.select(*by, F.col("id").alias("other"), F.array_max("distances").alias("_radius"))
    density = edges.join(radius, [*by, "other"]).groupBy(*by, "id").agg((1 / (F.avg(F.greatest("d", "_radius")) + 1e-10)).alias("density"))
    of_other = density.select(*by, F.col("id").alias("other"), F.col("density").alias("_there"))
    around = edges.join(of_other, [*by, "other"]).groupBy(*by, "id").agg(F.avg("_there").alias("_around"))
    scored = around.join(density, [*by, "id"]).select(*by, "id", (F.col("_around") / F.col("density")).alias("score"))
    return window_means(scored, points, by, width, length)


def nearest_vectors(vectors: DataFrame, by: list[str], k: int, *, p: float = 2, length: int = PART) -> DataFrame:
    """(by.., id, others, distances): the ``k`` nearest other vectors (by.., id, vector) of the same group; ids are integers, unique in
    a group, and vectors of a group have one length."""
    sizes = vectors.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / length).cast("long").alias("parts"))
    dealt = vectors.select(*by, F.col("id").cast("long").alias("id"), "vector").join(sizes, by).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    parts = dealt.groupBy(*by, "part").agg(F.first("parts").alias("parts"), F.array_sort(F.collect_list(F.struct("id", "vector"))).alias("rows"))
    parts = parts.select(*by, "part", "parts", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["vector"])).alias("values"))

    def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(row["ids"], np.int64)
        return ids, np.asarray(row["values"], float).reshape(len(ids), -1), 0

    return _met(parts, by, opened, lambda a, b: distances(a, b, p), k)
