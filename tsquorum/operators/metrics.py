"""Quality metrics against labels. Points are rows (by.., t, ..); ranges come from ``slices``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsquorum.operators.batches import by_batches
from tsquorum.operators.slices import mask_to_slices


def confusion(points: DataFrame, by: list[str], label: str = "is_anomaly", predicted: str = "predicted", beta: float = 1.0) -> DataFrame:
    """accuracy, precision, recall and F-beta per ``by``; what can't be computed is 0."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, p = F.col(label), F.col(predicted)
    tp, fp, fn, tn = count(y & p), count(~y & p), count(y & ~p), count(~y & ~p)
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    b2 = beta * beta
    f = F.when(precision + recall > 0, (1 + b2) * precision * recall / (F.lit(b2) * precision + recall)).otherwise(F.lit(0.0))
    return points.groupBy(*by).agg(((tp + tn) / F.count(F.lit(1))).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f.alias("f_beta"))


def hit_percentage(points: DataFrame, by: list[str], buffer: int = 0, label: str = "is_anomaly", predicted: str = "predicted") -> DataFrame:
    """Share of the labelled ranges with a prediction at most ``buffer`` points away; begins are clipped at 0."""
    ranges = mask_to_slices(points, by, label)
    hits = points.where(F.col(predicted)).select(*by, "t")
    wide = ranges.select(*by, "b", F.explode(F.sequence(F.greatest(F.col("b") - buffer, F.lit(0)), F.col("e") + buffer - 1)).alias("t"))
    found = wide.join(hits, [*by, "t"]).select(*by, "b").distinct().withColumn("_hit", F.lit(1.0))
    return ranges.join(found, [*by, "b"], "left").groupBy(*by).agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("hit_percentage"))


def range_scores(scores: DataFrame, labels: DataFrame, by: list[str], buffer: int = 0) -> DataFrame:
    """(by.., instance, b, score): the largest score of each instance in each labelled range."""
    ranges = mask_to_slices(labels, by, "is_anomaly")
    wide = ranges.select(*by, "b", F.explode(F.sequence(F.greatest(F.col("b") - buffer, F.lit(0)), F.col("e") + buffer - 1)).alias("t"))
    return scores.join(wide, [*by, "t"]).groupBy(*by, "instance", "b").agg(F.max("score").alias("score"))


def quality(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Mean over ranges of the best instance's score."""
    return ranges.groupBy(*by, "b").agg(F.max("score").alias("_s")).groupBy(*by).agg(F.avg("_s").alias("quality"))


def variance(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Mean over ranges of the sample deviation over instances."""
    return ranges.groupBy(*by, "b").agg(F.stddev_samp("score").alias("_s")).groupBy(*by).agg(F.avg("_s").alias("variance"))


def dcg(ranges: DataFrame, ranking: DataFrame, by: list[str]) -> DataFrame:
    """Discounted cumulative gain; an instance's relevance is its mean range score, ranks start at 0."""
    relevance = ranges.groupBy(*by, "instance").agg(F.avg("score").alias("_rel"))
    return relevance.join(ranking, [*by, "instance"]).groupBy(*by).agg(F.sum(F.col("_rel") / F.log2(F.col("rank") + 2)).alias("dcg"))


def variety(distances: DataFrame, by: list[str], kind: str = "overlap") -> DataFrame:
    """From pair distances (by.., i, j, d) with i < j: 1 - mean overlap distance, or 1 - 1 / (1e-10 + mean distance)."""
    mean = F.avg("d")
    return distances.groupBy(*by).agg((1 - mean if kind == "overlap" else 1 - 1 / (F.lit(1e-10) + mean)).alias("variety"))


def sc_score(quality_: Column, variety_: Column) -> Column:
    """Harmonic mean of quality and variety."""
    return F.when(quality_ + variety_ > 0, 2 * quality_ * variety_ / (quality_ + variety_)).otherwise(F.lit(0.0))


def _curve(scored: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Cumulative true and false positives at each distinct score, from the highest down."""
    per = scored.groupBy(*by, F.col(score).alias("at")).agg(F.sum(F.when(F.col(label), 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label), 0.0).otherwise(1.0)).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.col("at").desc())
    run, whole = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    return per.select(*by, "at", F.sum("p").over(run).alias("tp"), F.sum("n").over(run).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("neg"))


def roc_auc(scored: DataFrame, by: list[str], score: str = "score", label: str = "is_anomaly") -> DataFrame:
    """Area under the ROC curve by trapezoids; null if one class is missing."""
    down = Window.partitionBy(*by).orderBy(F.col("at").desc())
    curve = _curve(scored, by, score, label)
    area = (F.col("fp") - F.lag("fp", 1, 0.0).over(down)) * (F.col("tp") + F.lag("tp", 1, 0.0).over(down)) / 2
    return curve.withColumn("_a", area).groupBy(*by).agg(F.when(F.max("pos") * F.max("neg") > 0, F.sum("_a") / (F.max("pos") * F.max("neg"))).alias("roc_auc"))


def pr_auc(scored: DataFrame, by: list[str], score: str = "score", label: str = "is_anomaly") -> DataFrame:
    """Area under the precision-recall curve by trapezoids, the curve starting at precision 1; null without positives."""
    down = Window.partitionBy(*by).orderBy(F.col("at").desc())
    curve = _curve(scored, by, score, label).where("pos > 0")
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("pos")
    curve = curve.withColumn("_p", precision).withColumn("_r", recall)
    area = (F.col("_r") - F.lag("_r", 1, 0.0).over(down)) * (F.col("_p") + F.lag("_p", 1, 1.0).over(down)) / 2
    return curve.withColumn("_a", area).groupBy(*by).agg(F.sum("_a").alias("pr_auc"))


def cleaning_quality(points: DataFrame, by: list[str]) -> DataFrame:
    """precision, recall, F1 and F10 of the points masked out, for each ``by`` (series and period)."""
    masked = points.withColumn("predicted", ~F.col("keep"))
    one = confusion(masked, by).select(*by, "precision", "recall", F.col("f_beta").alias("f1"))
    return one.join(confusion(masked, by, beta=10.0).select(*by, F.col("f_beta").alias("f10")), by)


def cleaning_masks(masks: DataFrame, by: list[str]) -> DataFrame:
    """Masks of several base series with one period, joined by or."""
    return masks.groupBy(*by, "t").agg(F.bool_or("keep").alias("keep"))


# ------------------------------------------------------------------------------------------ range metrics (kernels)


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2], edge[1::2], strict=True))


def range_precision_recall(label: np.ndarray, predicted: np.ndarray, alpha: float = 0.5) -> tuple[float, float]:
    """Range-based precision and recall with flat bias: existence weighs ``alpha``, overlap the rest; several
    fragments over one range are worth their overlap divided by their number."""

    return _kept_precision_recall((label > 0).tobytes(), (predicted > 0).tobytes(), alpha)


@lru_cache(maxsize=1)
def _kept_precision_recall(labels: bytes, predictions: bytes, alpha: float) -> tuple[float, float]:
    """Precision, recall and F-score follow each other on the same series."""
    label, predicted = np.frombuffer(labels, bool), np.frombuffer(predictions, bool)

    def side(those: np.ndarray, others: np.ndarray, flags: np.ndarray, weight: float) -> float:
        if not len(those):
            return 0.0
        b, e = those.T
        fragments = np.searchsorted(others[:, 0], e) - np.searchsorted(others[:, 1], b, side="right")
        inside = np.concatenate([[0], np.cumsum(flags)])
        overlap = (inside[e] - inside[b]) / (e - b) / np.maximum(1, fragments)
        return float(np.cumsum(weight * (fragments > 0) + (1 - weight) * overlap)[-1] / len(those))

    real, found = (np.array(_ranges(x), int).reshape(-1, 2) for x in (label, predicted))
    return side(found, real, label, 0.0), side(real, found, predicted, alpha)


#: Numbers in a matrix of buffers by points beyond which buffers are taken apart.
MOST_NUMBERS = 2_000_000


def _range_areas(label: np.ndarray, score: np.ndarray, buffers: Iterable[int], steps: int) -> np.ndarray:
    """(ROC, PR) areas by buffer; see ``range_auc``."""
    n, ranges, positives = len(label), np.array(_ranges(label > 0), int).reshape(-1, 2), float(label.sum())
    buffers = np.array(list(buffers))
    if not len(ranges):
        return np.full((len(buffers), 2), np.nan)
    at, hot = np.arange(n), label > 0
    before = at - np.maximum.accumulate(np.where(hot, at, -n))
    away = np.minimum(before, np.minimum.accumulate(np.where(hot, at, 2 * n)[::-1])[::-1] - at)  # points to the nearest range
    order = np.argsort(-score, kind="stable")
    rank, away_sorted = -score[order], away[order]
    th = rank[np.unique(np.linspace(0, n - 1, steps).astype(int))]
    count = np.searchsorted(rank, th, side="right")  # points that score as high as each threshold
    # The largest score of each range and up to as many points on either side as a buffer reaches, side by side.
    b, e = ranges.T
    reach = np.arange(1, int(buffers.max()) // 2 + 1)
    padded = np.concatenate([score, [-np.inf]])
    beside = np.maximum(padded[np.where(b[:, None] >= reach, b[:, None] - reach, n)], padded[np.minimum(e[:, None] + reach - 1, n)])
    inner = np.maximum.reduceat(padded, ranges.ravel())[::2]
    tops = np.maximum.accumulate(np.concatenate([inner[:, None], beside], axis=1), axis=1).T
    def areas(some: np.ndarray) -> np.ndarray:
        half = some // 2
        near = np.sqrt(np.maximum(0, 1 - away_sorted / np.maximum(some, 1)[:, None]))
        soft = np.where(away_sorted <= half[:, None], near, 0.0)
        positive = ((positives + soft.sum(axis=1)) / 2)[:, None]
        none, one = np.zeros((len(some), 1)), np.ones((len(some), 1))
        tp = np.concatenate([none, np.cumsum(soft, axis=1)], axis=1)[:, count]
        seen = found[half]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.concatenate([none, np.minimum(tp / positive, 1.0) * seen, one], axis=1)
            f = np.concatenate([none, np.clip((count - tp) / (n - positive), 0.0, 1.0), one], axis=1)
        p = tp / np.maximum(1, count)
        roc = ((f[:, 1:] - f[:, :-1]) * (t[:, 1:] + t[:, :-1]) / 2).sum(axis=1)
        pr = ((t[:, 1:-1] - t[:, :-2]) * p).sum(axis=1)
        return np.where(positive < n, np.stack([roc, pr], axis=1), np.nan)

    first = np.searchsorted(th, -tops) + (len(th) + 1) * np.arange(len(tops))[:, None]  # the threshold from which on a range is found
    found = np.cumsum(np.bincount(first.ravel(), minlength=len(tops) * (len(th) + 1)).reshape(len(tops), -1), axis=1)[:, :-1] / len(ranges)
    step = max(1, MOST_NUMBERS // n)
    return np.concatenate([areas(buffers[i : i + step]) for i in range(0, len(buffers), step)])


def range_auc(label: np.ndarray, score: np.ndarray, buffer: int = 100, steps: int = 250) -> tuple[float, float]:
    """(ROC, PR) areas for labels that fade out over ``buffer`` / 2 points on either side (square root slopes), with
    recall scaled by the share of ranges found, as in volume-under-the-surface evaluation."""
    roc, pr = _kept_areas(label.tobytes(), label.dtype.str, score.tobytes(), score.dtype.str, (buffer,), steps)[0]
    return float(roc), float(pr)


def volumes(label: np.ndarray, score: np.ndarray, most: int = 100, step: int = 1) -> tuple[float, float]:
    """Mean range areas over all buffers from 0 to ``most``: volumes under the ROC and PR surfaces."""
    areas = _kept_areas(label.tobytes(), label.dtype.str, score.tobytes(), score.dtype.str, range(0, most + 1, step), 250)
    return tuple(np.nan_to_num(areas.mean(axis=0)))


@lru_cache(maxsize=2)
def _kept_areas(label: bytes, kind: str, score: bytes, score_kind: str, buffers: Iterable[int], steps: int) -> np.ndarray:
    """One area's or volume's metric follows the other on the same series, so the last areas are kept."""
    return _range_areas(np.frombuffer(label, kind), np.frombuffer(score, score_kind), buffers, steps)


#: A metric maps (labels, scores or predictions) to a number, and says whether it takes continuous scores.
METRICS: dict[str, tuple[Callable[[np.ndarray, np.ndarray], float], bool]] = {
    "RangePrAUC": (lambda y, s: range_auc(y, s)[1], True),
    "RangeRocAUC": (lambda y, s: range_auc(y, s)[0], True),
    "RangePrVUS": (lambda y, s: volumes(y, s)[1], True),
    "RangeRocVUS": (lambda y, s: volumes(y, s)[0], True),
    "RangePrecision": (lambda y, p: range_precision_recall(y, p)[0], False),
    "RangeRecall": (lambda y, p: range_precision_recall(y, p)[1], False),
    "RangeFScore": (lambda y, p: _f(*range_precision_recall(y, p)), False),
}


def _f(precision: float, recall: float) -> float:
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def register_metric(name: str, metric: Callable[[np.ndarray, np.ndarray], float], continuous: bool) -> None:
    METRICS[name] = (metric, continuous)


def range_metrics(points: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """(by.., metric, value) of registered metrics; many series at a time, each in memory whole.

    ``points`` has t, is_anomaly, score and predicted.
    """
    names = names or sorted(METRICS)
    chosen = {n: METRICS[n] for n in names}

    def run(table: pa.Table, begins: np.ndarray) -> pa.Table:
        labels, predicted = (np.array(table.column(c).combine_chunks().fill_null(False)) for c in ("is_anomaly", "predicted"))
        scores = table.column("score").to_numpy().astype(float)
        values = []
        for y, s, p in zip(*(np.split(x, begins[1:]) for x in (labels, scores, predicted)), strict=True):
            values += [f(y, s if continuous else p) for f, continuous in chosen.values()]
        found = table.select(by).take(pa.array(np.repeat(begins, len(chosen))))
        found = found.append_column("metric", pa.array(list(chosen) * len(begins), pa.string()))
        return found.append_column("value", pa.array(np.array(values, float), pa.float64(), from_pandas=True))

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in points.select(*by).schema] + ["metric string", "value double"])
    return by_batches(points.select(*by, "t", "is_anomaly", "score", "predicted"), by, run, schema)


def panel(points: DataFrame, by: list[str]) -> DataFrame:
    """All metrics of a scored series with predictions, one row per ``by``."""
    base = [
        roc_auc(points, by), pr_auc(points, by), confusion(points, by).drop("accuracy").withColumnRenamed("f_beta", "f_score"),
        range_metrics(points, by).groupBy(*by).pivot("metric", sorted(METRICS)).agg(F.first("value")), hit_percentage(points, by).withColumnRenamed("hit_percentage", "precision_at_k"),
    ]
    return reduce(lambda a, b: a.join(b, by, "left"), base)
