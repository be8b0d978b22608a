"""Anomaly injection: transforms of subsequences, as array expressions where deterministic, and the injecting kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tsquorum.functions.scalar import convolved, resampled
from tsquorum.operators.batches import MOST_ROWS, by_batches

# ------------------------------------------------------------------------------------------ native transforms (arrays)


def vmirror(x: Column) -> Column:
    """Backwards in time."""
    return F.reverse(x)


def hmirror(x: Column) -> Column:
    """Mirrored at the mean."""
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return F.transform(x, lambda v: 2 * mean - v)


def scale(x: Column, strength: float) -> Column:
    return F.transform(x, lambda v: v * F.lit(0.25 + 2 * strength))


def compress(x: Column, strength: float) -> Column:
    return resampled(x, F.floor(F.size(x) * F.lit(0.25 + (1 - strength) * 0.5)).cast("int"))


def stretch(x: Column, strength: float) -> Column:
    return resampled(x, F.floor(F.size(x) * F.lit(1.25 + 0.75 * strength)).cast("int"))


def gaussian_kernel(n: int, strength: float) -> list[float]:
    size = max(1, round((0.05 + 0.45 * strength) * n))
    at = np.linspace(-1, 1, size) if size > 1 else np.zeros(1)
    k = np.exp(-0.5 * (at / 0.5) ** 2)
    return (k / k.sum()).tolist()


def smoothing(x: Column, n: int, strength: float) -> Column:
    """Gaussian kernel over arrays of length ``n``."""
    return convolved(x, gaussian_kernel(n, strength))


# ------------------------------------------------------------------------------------------ kernels


@dataclass(frozen=True)
class Transform:
    """A transform of a subsequence by a strength in [0, 1], with the beta law that strengths are drawn from."""

    letter: str
    beta: tuple[float, float]
    run: Callable[[np.ndarray, float, np.random.Generator, tuple[float, float]], tuple[np.ndarray, np.ndarray]]


def _all(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x, np.ones(len(x), bool)


def _resize(x: np.ndarray, n: int) -> np.ndarray:
    return np.interp(np.linspace(0, len(x) - 1, max(n, 2)), np.arange(len(x)), x)


def _outlier(x, s, rng, span):
    n = len(x)
    at = int(rng.integers(max(1, int(0.1 * n)), max(2, int(0.9 * n))))
    lo, hi = span
    out, label = x.copy(), np.zeros(n, bool)
    up = rng.random() < 0.5
    out[at] += (s + 0.25) * ((hi - x[at]) if up else (lo - x[at])) + (s + 0.25) * ((hi - lo) if up else (lo - hi))
    label[at] = True
    return out, label


#: Shapes by strength decile: functions of phase.
_SHAPES = (
    lambda p: np.sin(p), lambda p: np.sign(np.sin(p)), lambda p: 2 * (p / (2 * np.pi) % 1) - 1, lambda p: np.abs(2 * (p / (2 * np.pi) % 1) - 1) * 2 - 1, lambda p: np.sin(p) * np.sin(3 * p),
    lambda p: np.sin(p) ** 3, lambda p: np.sign(np.sin(p)) * np.sin(2 * p), lambda p: np.sin(p + np.sin(2 * p)), lambda p: np.exp(-((p % (2 * np.pi) - np.pi) ** 2)) * 2 - 1, lambda p: np.cumsum(np.sin(p * 1.7)) / max(1, len(p) ** 0.5),
)


def _pattern(x, s, rng, span):
    shape = _SHAPES[min(9, int(s * 10))]
    phase = np.linspace(0, 2 * np.pi * max(1, len(x) // 25), len(x)) + rng.uniform(0, 2 * np.pi)
    return _all(x.mean() + shape(phase) * (x.max() - x.min()) / 4)


#: The letters of anomaly types in annotation codes, and the beta laws of their strengths.
TRANSFORMS: dict[str, Transform] = {
    "extremum": Transform("E", (2.0, 2.0), _outlier),
    "compress": Transform("C", (1.0, 1.0), lambda x, s, rng, span: _all(_resize(x, int(len(x) * (0.25 + (1 - s) * 0.5))))),
    "stretch": Transform("S", (1.0, 1.0), lambda x, s, rng, span: _all(_resize(x, int(len(x) * (1.25 + 0.75 * s))))),
    "noise": Transform("N", (3.0, 1.0), lambda x, s, rng, span: _all(x + rng.normal(0, (0.02 + 0.23 * s) * max(x.std(), 1e-12), len(x)))),
    "smoothing": Transform("M", (1.0, 1.0), lambda x, s, rng, span: _all(np.convolve(x, gaussian_kernel(len(x), s), "same"))),
    "hmirror": Transform("H", (1e10, 1.0), lambda x, s, rng, span: _all(2 * x.mean() - x)),
    "vmirror": Transform("V", (1e10, 1.0), lambda x, s, rng, span: _all(x[::-1].copy())),
    "scale": Transform("A", (0.5, 0.5), lambda x, s, rng, span: _all(x * (0.25 + 2 * s))),
    "pattern": Transform("P", (1.0, 1.0), _pattern),
}


def register(name: str, transform: Transform) -> None:
    TRANSFORMS[name] = transform


def sample_strength(kind: str, rng: np.random.Generator) -> float:
    """From the type's beta law, but not near one half, where some transforms change little."""
    while abs((s := float(rng.beta(*TRANSFORMS[kind].beta))) - 0.5) < 0.05:
        pass
    return s


#: Where the sections' odds, 30, 40 and 30 percent, end, as the generator's choice adds them up.
_SECTIONS = np.cumsum((0.3, 0.4, 0.3)) / np.cumsum((0.3, 0.4, 0.3))[-1]


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """``np.allclose``, without its overhead where all differences are finite."""
    off = np.abs(a - b)
    return bool((off <= 1e-8 + 1e-5 * np.abs(b)).all()) if np.isfinite(off).all() else np.allclose(a, b)


def inject(values: np.ndarray, label: np.ndarray, cuts: np.ndarray, kinds: list[str], length: int, rng: np.random.Generator, most: float = 0.15, tries: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Values, labels, cut points and annotations after injecting one anomaly per entry of ``kinds``.

    Places keep a quarter of the length off labels, cuts and ends; a third lies in each of the sections 30, 40 and 30
    percent with these odds. What changes nothing is tried again; contamination stays below ``most``.
    """
    notes: list[dict] = []
    for kind in kinds:
        for _ in range(tries):
            n, margin = len(values), length // 4
            if n < 2 * length + 2 * margin or label.sum() + length > most * n:
                break
            section = int(np.searchsorted(_SECTIONS, rng.random(), side="right"))
            lo, hi = (0, int(0.3 * n)) if section == 0 else (int(0.3 * n), int(0.7 * n)) if section == 1 else (int(0.7 * n), n)
            lo, hi = max(lo, margin), min(hi, n - length - margin)
            if hi <= lo:
                continue
            at = int(rng.integers(lo, hi))
            b, e = at - margin, at + length + margin
            if label[b:e].any() or ((cuts > b) & (cuts < e)).any():
                continue
            s = sample_strength(kind, rng)
            old = values[at : at + length]
            new, mark = TRANSFORMS[kind].run(old, s, rng, (float(values.min()), float(values.max())))
            if len(new) == len(old) and _alike(new, old):
                continue
            values = np.concatenate([values[:at], new, values[at + length :]])
            label = np.concatenate([label[:at], mark, label[at + length :]])
            shift = len(new) - length
            cuts = np.where(cuts >= at + length, cuts + shift, cuts)
            for note in notes:
                if note["position"] > at:
                    note["position"] += shift
            where = at + int(np.flatnonzero(mark)[0]) if mark.any() else at
            notes.append({"position": where, "length": int(mark.sum()), "anomaly_type": kind, "strength": s})
            break
    good = ~np.isnan(values)
    return values[good], label[good], cuts, sorted(notes, key=lambda a: a["position"])


def annotation_code(notes: Column) -> Column:
    """One letter, strength in percent and length per annotation, in order of position."""
    letter = F.create_map(*[F.lit(v) for k, t in TRANSFORMS.items() for v in (k, t.letter)])
    one = lambda a: F.concat(a["position"].cast("string"), F.lit("["), letter[a["anomaly_type"]], F.round(a["strength"] * 100).cast("int").cast("string"), F.lit("("), a["length"].cast("string"), F.lit(")]"))
    return F.array_join(F.transform(F.array_sort(notes), one), "")


NOTES = "array<struct<position:bigint,length:bigint,anomaly_type:string,strength:double>>"


def injection_plan(base: DataFrame, by: list[str], kinds: list[str], lengths: Column) -> DataFrame:
    """(by.., anomaly_type, length): every type with every admissible length of a base series."""
    typed = base.select(*by, F.explode(F.array(*[F.lit(k) for k in kinds])).alias("anomaly_type"), lengths.alias("_lengths"))
    return typed.select(*by, "anomaly_type", F.explode("_lengths").alias("length"))


def admissible_lengths(period: Column, n: Column, fixed: tuple[int, ...] = (50, 100), factors: tuple[float, ...] = (1.0,), fraction: float = 0.1) -> Column:
    """Fixed lengths and multiples of the period, without repeats, up to a fraction of the series."""
    every = F.array(*[F.lit(x) for x in fixed], *[F.floor(period * F.lit(f)).cast("int") for f in factors])
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: (x > 0) & (x <= n * F.lit(fraction)))))


def inject_all(points: DataFrame, plan: DataFrame, by: list[str], seed: int = 42) -> DataFrame:
    """Training series (by.., anomaly_type, length, t, value, is_anomaly, annotations) for each row of the plan.

    ``annotations`` is filled at t = 0. Series whose injection failed are left out.
    """
    # A series' rows of the plan come before its points, so that points move once, whatever the number of anomalies.
    planned = plan.select(*by, F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("boolean").alias("is_anomaly"), "anomaly_type", F.col("length").cast("int").alias("length"))
    own = points.select(*by, F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"), "is_anomaly", F.lit(None).cast("string").alias("anomaly_type"), F.lit(None).cast("int").alias("length"))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*by).schema)
    schema = f"{keys}, anomaly_type string, length int, t bigint, value double, is_anomaly boolean, annotations {NOTES}"
    notes_type = to_arrow_type(StructType.fromDDL(f"notes {NOTES}")["notes"].dataType)

    def run(table: pa.Table, begins: np.ndarray) -> Iterator[pa.Table]:
        kinds, lengths = table.column("anomaly_type").to_pylist(), table.column("length").to_pylist()
        values, labels = table.column("value").to_numpy(), np.array(table.column("is_anomaly").combine_chunks().fill_null(False))
        made, n = [], 0
        for b, e in zip(begins, [*begins[1:], len(values)], strict=True):
            first = next((i for i in range(b, e) if kinds[i] is None), e)
            for i in range(b, first):
                v, y, _, notes = inject(values[first:e], labels[first:e], np.zeros(0, int), [kinds[i]], lengths[i], np.random.default_rng(seed))
                if notes:
                    made.append((i, v, y, notes))
                    n += len(v)
                if n >= MOST_ROWS:
                    yield rows(table, made)
                    made, n = [], 0
        if made:
            yield rows(table, made)

    def rows(table: pa.Table, made: list[tuple]) -> pa.Table:
        sizes = [len(v) for _, v, _, _ in made]
        t = np.concatenate([np.arange(n) for n in sizes])
        noted = pa.array(np.repeat(np.arange(len(made)), sizes), mask=t > 0)  # at t = 0
        out = table.select([*by, "anomaly_type", "length"]).take(pa.array(np.repeat([i for i, _, _, _ in made], sizes)))
        columns = {"t": pa.array(t), "value": pa.array(np.concatenate([v for _, v, _, _ in made])), "is_anomaly": pa.array(np.concatenate([y for _, _, y, _ in made])), "annotations": pa.array([notes for _, _, _, notes in made], notes_type).take(noted)}
        for name, column in columns.items():
            out = out.append_column(name, column)
        return out

    return by_batches(own.unionByName(planned), by, run, schema)
