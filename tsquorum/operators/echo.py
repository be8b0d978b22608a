"""Echo state networks on sequences of small images (blocks of points by dimensions): input maps, trends, readouts, step-by-step prediction."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ------------------------------------------------------------------------------------------ cosine transforms


def cosine_basis(n: int, k: int) -> np.ndarray:
    """Columns 2 cos(pi (x + 1/2) j / n) of the slow cosine transform."""
    return 2 * np.cos(np.pi * (np.arange(n)[:, None] + 0.5) * np.arange(k) / n)


def slow_cosine(f: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of ``f`` (along its first axis) in a basis; ``basis @ coefficients`` goes back."""
    return np.linalg.lstsq(basis, f, rcond=None)[0]


def slow_cosine2(image: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return slow_cosine(slow_cosine(image.T, columns).T, rows)


def inverse_slow_cosine2(coefficients: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return rows @ coefficients @ columns.T


def cosine_matrix(n: int) -> np.ndarray:
    """The orthonormal cosine transform as a matrix: its rows are the basis, its transpose is its inverse."""
    c = np.sqrt(2 / n) * np.cos(np.pi * (np.arange(n) + 0.5) * np.arange(n)[:, None] / n)
    c[0] /= np.sqrt(2)
    return c


def cosine2(images: np.ndarray, rows: int | None = None, columns: int | None = None) -> np.ndarray:
    """The first coefficients of images (.., y, x), orthonormal in both directions."""
    y, x = images.shape[-2:]
    return cosine_matrix(y)[:rows] @ images @ cosine_matrix(x)[:columns].T


def inverse_cosine2(coefficients: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Images of a size from their first coefficients; a larger size is a smooth enlargement."""
    k, j = coefficients.shape[-2:]
    return cosine_matrix(shape[0])[:k].T @ coefficients @ cosine_matrix(shape[1])[:j]


def stretched(f: np.ndarray, n: int) -> np.ndarray:
    """A series (first axis: time) smoothly resampled to ``n`` points: its cosine coefficients, padded or cut."""
    k = min(len(f), n)
    return np.tensordot(cosine_matrix(n)[:k].T, np.tensordot(cosine_matrix(len(f))[:k], f, 1), 1)


# ------------------------------------------------------------------------------------------ trends


def polynomial_trend(f: np.ndarray, degree: int) -> np.ndarray:
    """Least-squares coefficients, the constant first, for every series along the first axis."""
    return np.linalg.lstsq(np.arange(len(f))[:, None] ** np.arange(degree + 1.0), f.reshape(len(f), -1), rcond=None)[0].reshape(degree + 1, *f.shape[1:])


def _trend(b: np.ndarray, n: int) -> np.ndarray:
    return np.tensordot(np.arange(n)[:, None] ** np.arange(float(len(b))), b, 1)


def _cycle_of(cycle: np.ndarray, n: int) -> np.ndarray:
    return cycle[np.arange(n) % len(cycle)]


def without_trend(f: np.ndarray, cycle: int, scale: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rest, trend, mean cycle) of the series along the first axis: less its quadratic trend, then less the mean of its whole cycles.

    With ``scale`` the series is stretched to so many points, where the cycle has a whole length, and back.
    """
    n = len(f)
    b = polynomial_trend(f, 2)
    rest = f - _trend(b, n)
    if scale is not None:
        rest = stretched(rest, scale)
    whole = len(rest) // cycle
    if not whole:
        raise ValueError("the series is shorter than a cycle")
    mean = rest[: whole * cycle].reshape(whole, cycle, *f.shape[1:]).mean(axis=0)
    rest = rest - _cycle_of(mean, len(rest))
    return (stretched(rest, n) if scale is not None else rest), b, mean


def with_trend(rest: np.ndarray, b: np.ndarray, cycle: np.ndarray, scale: int | None = None, start: int = 0) -> np.ndarray:
    """The inverse of ``without_trend``. ``start`` is where ``rest`` begins in the series that trend and cycle come from: so a
    constant rest after the series' end gives the prediction from trend and cycle alone."""
    n = len(rest)
    end = _trend(b, start + n)[start:]
    if scale is None:
        return rest + end + _cycle_of(cycle, start + n)[start:]
    return stretched(stretched(rest, scale) + _cycle_of(cycle, scale), n) + end


# ------------------------------------------------------------------------------------------ image distance


def image_metric(shape: tuple[int, int], sigma: float = 1.0) -> np.ndarray:
    """Weights by which pixels count for each other: a normal law of their distance."""
    y, x = np.divmod(np.arange(shape[0] * shape[1]), shape[1])
    apart = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
    return np.exp(-apart / (2 * sigma**2)) / (2 * np.pi * sigma**2)


def image_distance(a: np.ndarray, b: np.ndarray, metric: np.ndarray | None = None) -> np.ndarray:
    """Squared distance of images (n, y, x) under a metric; None: the plain sum of squares."""
    d = (a - b).reshape(len(a), -1)
    return (d**2).sum(axis=1) if metric is None else np.einsum("ij,jk,ik->i", d, metric, d)


def metric_roots(metric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symmetric square root of a metric, and its inverse; eigenvalues are kept away from 0."""
    w, v = np.linalg.eigh(metric)
    s = np.sqrt(np.maximum(w, 1e-10 * w.max()))
    return (v * s) @ v.T, (v / s) @ v.T


# ------------------------------------------------------------------------------------------ input maps


def resampled(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bilinear values on an even grid from corner to corner."""
    y, x = (np.linspace(0, s - 1, t) for s, t in zip(image.shape, size, strict=True))
    i, j = (np.minimum(p.astype(int), max(0, s - 2)) for p, s in zip((y, x), image.shape, strict=True))
    u, v = (y - i)[:, None], x - j
    k, m = np.minimum(i + 1, image.shape[0] - 1), np.minimum(j + 1, image.shape[1] - 1)
    return (1 - u) * ((1 - v) * image[np.ix_(i, j)] + v * image[np.ix_(i, m)]) + u * ((1 - v) * image[np.ix_(k, j)] + v * image[np.ix_(k, m)])


def kernel(kind: str, size: tuple[int, int], rng: np.random.Generator) -> np.ndarray:
    """Weights of a convolution: "mean", "gauss" or "random"."""
    if kind == "mean":
        return np.full(size, 1 / (size[0] * size[1]))
    if kind == "gauss":
        one, two = (np.exp(-0.5 * np.linspace(-2, 2, s) ** 2) if s > 1 else np.ones(1) for s in size)
        k = np.outer(one, two)
        return k / k.sum()
    if kind == "random":
        return rng.uniform(-1, 1, size)
    raise ValueError(f"no kernel {kind!r}")


def _spread(x: np.ndarray) -> np.ndarray:
    """To -1..1; a constant to -1."""
    span = x.max() - x.min()
    return 2 * (x - x.min()) / span - 1 if span else np.full(x.shape, -1.0)


def features(image: np.ndarray, maps: list[dict]) -> np.ndarray:
    """The features of an image, one map after another. A map has a type, a scale, and what its type needs:
    pixels (size), cosine (size), gradient, convolution (weights, same: mirrored borders), weights (weights, bias), chain (maps)."""
    out = []
    for m in maps:
        kind = m["type"]
        if kind == "pixels":
            f = resampled(image, m["size"])
        elif kind == "cosine":
            f = cosine2(image, *m["size"])
        elif kind == "gradient":
            f = _spread(np.concatenate([np.gradient(image, axis=a) if image.shape[a] > 1 else np.zeros_like(image) for a in (0, 1)]))
        elif kind == "convolution":
            w = m["weights"]
            padded = np.pad(image, [((s - 1) // 2, s // 2) for s in w.shape], mode="symmetric") if m.get("same") else image
            f = _spread(np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(padded, w.shape), w[::-1, ::-1]))
        elif kind == "weights":
            f = m["weights"] @ image.reshape(-1) + m["bias"]
        elif kind == "chain":
            f = image
            for part in m["maps"]:
                f = features(np.atleast_2d(f), [part])
        else:
            raise ValueError(f"no input map {kind!r}")
        out.append(m.get("scale", 1.0) * f.reshape(-1))
    return np.concatenate(out)


# ------------------------------------------------------------------------------------------ network


def reservoir(size: int, per_row: int, radius: float, rng: np.random.Generator) -> np.ndarray:
    """Random weights, ``per_row`` of each row not 0, with a spectral radius."""
    w = np.zeros((size, size))
    for row in w:
        row[rng.choice(size, per_row, replace=False)] = rng.uniform(-1, 1, per_row)
    return w * (radius / max(np.abs(np.linalg.eigvals(w)).max(), 1e-12))


def readout(inputs: np.ndarray, states: np.ndarray, labels: np.ndarray, method: str = "pinv_svd", beta: float | None = None, metric: np.ndarray | None = None) -> np.ndarray:
    """Output weights (labels by 1 + inputs + states), for one training sequence or a stack of them (.., time, values).

    "pinv_svd" leaves out singular values below 1/10,000 of the largest, "pinv_lstsq" is plain least squares, "tikhonov" adds ``beta``.
    With a ``metric`` inputs and labels are weighed by its square root first.
    """
    back = None
    if metric is not None:
        root, back = metric_roots(metric)
        inputs, labels = inputs @ root, labels @ root
    x = np.concatenate([np.ones((*inputs.shape[:-1], 1)), inputs, states], axis=-1)
    if method == "tikhonov":
        if beta is None:
            raise ValueError("tikhonov needs beta")
        xt = np.swapaxes(x, -1, -2)
        w = np.linalg.solve(xt @ x + beta * np.eye(x.shape[-1]), xt @ labels)
    elif method in ("pinv_svd", "pinv_lstsq"):
        u, s, v = np.linalg.svd(x, full_matrices=False)
        least = s[..., :1] * (1e-4 if method == "pinv_svd" else np.finfo(float).eps * max(x.shape[-2:]))
        inverse = np.where(s > least, 1 / np.where(s > least, s, 1.0), 0.0)
        w = np.swapaxes(v, -1, -2) @ (inverse[..., None] * (np.swapaxes(u, -1, -2) @ labels))
    else:
        raise ValueError(f"no training method {method!r}")
    w = np.swapaxes(w, -1, -2)
    return w if back is None else back @ w


class Network:
    """A reservoir with its input map. ``advance`` takes the states of many sequences one image further."""

    def __init__(self, shape: tuple[int, int], size: int, scale: float, radius: float, density: float, rng: np.random.Generator, maps: list[dict] | None = None) -> None:
        if maps is None:
            maps = [{"type": "weights", "weights": rng.uniform(-1, 1, (size, shape[0] * shape[1])), "bias": rng.uniform(-1, 1, size), "scale": scale}]
        self.shape, self.maps = shape, maps
        self.size = len(features(np.zeros(shape), maps))
        self.weights = reservoir(self.size, max(1, int(self.size * density)), radius, rng)

    def mapped(self, images: np.ndarray) -> np.ndarray:
        if len(self.maps) == 1 and self.maps[0]["type"] == "weights":
            m = self.maps[0]
            return m.get("scale", 1.0) * (images.reshape(*images.shape[:-2], -1) @ m["weights"].T + m["bias"])
        flat = images.reshape(-1, *self.shape)
        return np.array([features(i, self.maps) for i in flat]).reshape(*images.shape[:-2], self.size)

    def advance(self, mapped: np.ndarray, states: np.ndarray) -> np.ndarray:
        return np.tanh(mapped + states @ self.weights.T)


def predicted(images: np.ndarray, network: Network, train: int, ahead: int, transient: int, method: str = "pinv_svd", beta: float | None = None, metric: np.ndarray | None = None, together: int = 64) -> np.ndarray:
    """Predictions (steps, ahead, y, x): at every step a readout is trained on ``train`` images and runs freely for the next ``ahead``.

    Each step starts from a zero state; steps are independent and are taken ``together`` at a time. The first ``transient`` states of a step don't count.
    """
    steps = len(images) - train - ahead
    mapped, flat = network.mapped(images), images.reshape(len(images), -1)
    out = np.empty((max(0, steps), ahead, *network.shape))
    for lo in range(0, steps, together):
        at = np.arange(lo, min(steps, lo + together))
        state, states = np.zeros((len(at), network.size)), []
        for t in range(train):
            state = network.advance(mapped[at + t], state)
            states.append(state)
        seen = np.arange(min(transient, train - 1), train)
        trained = np.stack([states[t] for t in seen], axis=1)
        w = readout(flat[at[:, None] + seen], trained, flat[at[:, None] + seen + 1], method, beta, metric)
        image = flat[at + train]
        for t in range(ahead):
            state = network.advance(network.mapped(image.reshape(-1, *network.shape)), state)
            image = np.einsum("sij,sj->si", w, np.concatenate([np.ones((len(at), 1)), image, state], axis=1))
            out[at, t] = image.reshape(-1, *network.shape)
    return out


def window_scores(error: np.ndarray, small: int, large: int) -> np.ndarray:
    """Per step and column: how likely the mean of the next ``small`` errors is not one of the ``large - 1`` before; the first
    tenth of a large window scores 0. erf(max(0, difference) / deviation / sqrt(2))."""
    n = len(error)
    c = np.concatenate([np.zeros((1, *error.shape[1:])), np.cumsum(error, axis=0)])
    c2 = np.concatenate([np.zeros((1, *error.shape[1:])), np.cumsum(error**2, axis=0)])
    i = np.arange(n)
    b, e = np.maximum(0, i - large + 1), np.minimum(n, i + small)
    span = lambda x: x.reshape(-1, *[1] * (error.ndim - 1))
    k = span(np.maximum(i - b, 1))
    mean = (c[i] - c[b]) / k
    std = np.sqrt(np.maximum((c2[i] - c2[b]) / k - mean**2, 0))
    x = np.maximum(0, (c[e] - c[i]) / span(e - i) - mean) / (std + (std < 1e-10))
    score = np.vectorize(math.erf, otypes=[float])(x / np.sqrt(2))
    score[: max(1, large // 10)] = 0
    return score


def echo_scores(values: np.ndarray, params: dict, rng: np.random.Generator) -> np.ndarray:
    """Scores per point of a series (points) or (points, dimensions): errors of step-by-step predictions of blocks of points.

    The last block is padded with zeros. Where a series has too few blocks for the windows, they shrink in proportion; with fewer than
    5 blocks all scores are 0. Points before the first prediction take the least score.
    """
    x = values.reshape(len(values), -1).astype(float)
    n, dims = x.shape
    block = max(1, int(params["context_window_size"]))
    pad = -n % block
    images = np.vstack([x, np.zeros((pad, dims))]).reshape(-1, block, dims)
    train, ahead = int(params["train_window_size"]), int(params["prediction_window_size"])
    room = len(images) - 2
    if room < 3:
        return np.zeros(n)
    if train + ahead > room:
        ahead = max(1, min(ahead, room * ahead // (train + ahead)))
        train = max(2, room - ahead)
    transient = max(0, min(int(params["transient_window_size"]), train // 2))
    low, high = images.min(), images.max()
    if high == low:
        return np.zeros(n)
    images = 2 * (images - low) / (high - low) - 1
    network = Network((block, dims), max(int(params["input_map_size"]), block), params["input_map_scale"], params["spectral_radius"], params["density"], rng)
    metric = image_metric((block, dims)) if params.get("imed_loss") else None
    made = predicted(images, network, train, ahead, transient, params.get("train_method", "pinv_svd"), params.get("tikhonov_beta"), metric)
    steps = len(made)
    targets = images[np.arange(steps)[:, None] + train + 1 + np.arange(ahead)]
    with np.errstate(over="ignore", invalid="ignore"):
        error = np.minimum(np.nan_to_num(np.abs(targets - made), nan=1e6, posinf=1e6), 1e6).mean(axis=-1).mean(axis=1)
    score = window_scores(error, int(params["scoring_small_window_size"]), int(params["scoring_large_window_size"])).ravel()
    # A score is of the block after its training and the ones predicted with it: the mean of all that cover a point.
    width, first = ahead * block + 1, train * block
    total, count = np.zeros(len(images) * block + width + 1), np.zeros(len(images) * block + width + 1)
    at = first + np.arange(len(score))
    np.add.at(total, at, score), np.add.at(total, at + width, -score)
    np.add.at(count, at, 1), np.add.at(count, at + width, -1)
    total, count = np.cumsum(total)[:n], np.cumsum(count)[:n]
    out = np.where(count > 0, np.maximum(total, 0) / np.maximum(count, 1), np.nan)
    return np.where(np.isnan(out), np.nanmin(out) if (count > 0).any() else 0.0, out)


def block_cosines(points: DataFrame, by: list[str], block: int, k: int) -> DataFrame:
    """(by.., block, j, coefficient): the first ``k`` orthonormal cosine coefficients of whole blocks of points (by.., t, value), as grouped sums."""
    place = F.col("t") % block
    j = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")
    spread = points.select(*by, F.floor(F.col("t") / block).cast("long").alias("block"), place.alias("x"), "value", j)
    scale = F.when(F.col("j") == 0, F.lit((1 / block) ** 0.5)).otherwise(F.lit((2 / block) ** 0.5))
    sums = spread.groupBy(*by, "block", "j").agg(F.sum(F.col("value") * F.cos(F.lit(math.pi) * (F.col("x") + 0.5) * F.col("j") / block)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return sums.where(F.col("_n") == block).select(*by, "block", "j", (scale * F.col("_s")).alias("coefficient"))
