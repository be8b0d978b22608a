"""Scalar functions as Column expressions, all inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation 7.1.26 of Abramowitz and Stegun, |error| < 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """The error function, to 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def erf_sql(x: str) -> str:
    """The same as SQL text."""
    t = f"(1.0 / (1.0 + {ERF_P} * abs({x})))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})) * {t})"
    return f"(sign({x}) * (1.0 - {poly} * exp(-({x}) * ({x}))))"


def erfinv(y: Column) -> Column:
    """Inverse error function by Winitzki's closed form and two Newton steps on ``erf``."""
    a = 0.147
    log = F.log(F.lit(1.0) - y * y)
    first = F.lit(2 / (math.pi * a)) + log / 2
    x = F.signum(y) * F.sqrt(F.sqrt(first * first - log / a) - first)
    for _ in range(2):
        x = x - (erf(x) - y) * F.lit(math.sqrt(math.pi) / 2) * F.exp(x * x)
    return x


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def truncated(c: Column, digits: int = 6) -> Column:
    """Cut off after ``digits`` decimals, not rounded, as binned parameters are."""
    scale = F.lit(float(10**digits))
    return F.when(c < 0, F.ceil(c * scale)).otherwise(F.floor(c * scale)) / scale


def binned_map(params: Column) -> Column:
    """A map of numbers with every value cut off to six decimals; the key of binned comparisons."""
    return F.transform_values(params, lambda _, v: truncated(v))


def canonical_params(params: Column) -> Column:
    """JSON of a map with sorted keys, so equal settings have equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def params_id(params: Column) -> Column:
    return F.md5(canonical_params(params))


def instance_id(algorithm: Column, params: Column) -> Column:
    return F.concat_ws("-", algorithm, params_id(params))


def nested_hash(params: Column) -> Column:
    """Order-free hash of a map: exclusive or over its entries."""
    return F.aggregate(F.map_entries(params), F.lit(0).cast("long"), lambda h, e: h.bitwiseXOR(F.xxhash64(e["key"], e["value"])))


def restricted(params: Column, known: Column) -> Column:
    """The entries of a map whose keys are among ``known``."""
    return F.map_filter(params, lambda k, _: F.array_contains(known, k))


def merged(base: Column, new: Column) -> Column:
    """``base`` updated by ``new``."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(new, k)), new)


def format_bytes(n: Column) -> Column:
    """1536 -> 1.5 kiB."""
    out = F.concat(F.format_number(n.cast("double"), 0), F.lit(" B"))
    for power, unit in enumerate(("kiB", "MiB", "GiB", "TiB"), 1):
        size = float(1024**power)
        out = F.when(F.abs(n) >= size, F.concat(F.format_number(n / F.lit(size), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_nanos(ns: Column) -> Column:
    """Nanoseconds as ns, us, ms, s, min, h or d; from one millisecond on the next larger unit that holds 1."""
    steps = ((1.0, "ns"), (1e3, "us"), (1e6, "ms"), (1e9, "s"), (60e9, "min"), (3600e9, "h"), (86400e9, "d"))
    out = F.concat(F.format_number(ns.cast("double"), 2), F.lit(" ns"))
    for size, unit in steps[1:]:
        out = F.when(F.abs(ns) >= size, F.concat(F.format_number(ns / F.lit(size), 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def name_timestamp(name: Column) -> Column:
    """The day at the start of a backup's name, at noon, two hours east of Greenwich."""
    day = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(day != "", F.to_timestamp(F.concat(day, F.lit(" 12:00:00+02:00"))))


def clean_dataset_name(name: Column, parent: Column) -> Column:
    """``test`` takes its folder's name; ``.test`` at the end and ``KPI-`` at the start go."""
    return F.regexp_replace(F.regexp_replace(F.when(name == "test", parent).otherwise(name), r"\.test$", ""), r"^KPI-", "")


def resampled(values: Column, n: Column) -> Column:
    """Linear interpolation of an array at ``n`` equally spaced places from its first to its last element."""
    last = (F.size(values) - 1).cast("double")
    step = F.when(n > 1, last / (n - 1)).otherwise(F.lit(0.0))

    def at(i: Column) -> Column:
        x = F.least(i * step, last)
        low = F.floor(x).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
        return a + (b - a) * (x - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.expr("cast(array() as array<double>)"))


def convolved(values: Column, kernel: list[float]) -> Column:
    """Discrete convolution with a constant kernel, the middle as long as the longer operand ('same' mode)."""
    m = len(kernel)
    shift = (m - 1) // 2

    def at(_: Column, i: Column) -> Column:
        terms = [F.coalesce(F.get(values, i + (shift - k)), F.lit(0.0)) * F.lit(float(w)) for k, w in enumerate(kernel)]
        return sum(terms[1:], terms[0])

    return F.transform(values, at)
