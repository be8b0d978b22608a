"""Configuration in six sections, from defaults, a mapping (as read from YAML or JSON), and the environment.

An environment variable TSQUORUM__SECTION__KEY overrides a value.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace

from tsquorum.operators.detectors import DETECTORS
from tsquorum.operators.injection import TRANSFORMS
from tsquorum.operators.scores import COMBINATIONS, NORMALIZATIONS
from tsquorum.operators.selection import SELECTIONS


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class General:
    seed: int = 42
    algorithms: tuple[str, ...] = tuple(DETECTORS)
    max_instances: int = 6

    def check(self) -> None:
        _need(set(self.algorithms) <= set(DETECTORS), f"unknown algorithms in {self.algorithms}")
        _need(self.max_instances > 0, "max_instances must be positive")


@dataclass(frozen=True)
class DataGeneration:
    max_period: int = 600
    period_share: float = 0.1
    least_length: int = 2000
    periods: int = 10
    snippets: int = 3
    overlap: float = 0.1
    similarity: float = 0.0005

    def check(self) -> None:
        _need(0 < self.period_share <= 1 and 0 <= self.overlap < 1, "shares must lie in [0, 1]")


@dataclass(frozen=True)
class Cleaning:
    quantile: float = 0.9
    votes: float = 0.7
    reach: int = 100
    by_labels: bool = False

    def check(self) -> None:
        _need(0 < self.quantile < 1 and 0 < self.votes <= 1, "quantile and votes must lie in (0, 1]")


@dataclass(frozen=True)
class Anomalies:
    kinds: tuple[str, ...] = tuple(TRANSFORMS)
    lengths: tuple[int, ...] = (50, 100)
    factors: tuple[float, ...] = (1.0,)
    fraction: float = 0.1
    contamination: float = 0.15

    def check(self) -> None:
        _need(set(self.kinds) <= set(TRANSFORMS), f"unknown anomaly types in {self.kinds}")
        _need(0 < self.contamination < 1, "contamination must lie in (0, 1)")


@dataclass(frozen=True)
class Optimization:
    max_trials: int = 20
    quality: float = 0.95
    enough: int = 10
    epsilon: float = 0.02
    deviation: float = 0.05
    rounds: int = 2

    def check(self) -> None:
        _need(self.max_trials > 0 and self.rounds > 0, "trials and rounds must be positive")


@dataclass(frozen=True)
class Scoring:
    selections: tuple[str, ...] = ("training-result",)
    normalizations: tuple[str, ...] = ("minmax",)
    combinations: tuple[str, ...] = ("custom",)
    metric: str = "range_pr_auc"

    def check(self) -> None:
        for names, known in ((self.selections, SELECTIONS), (self.normalizations, NORMALIZATIONS), (self.combinations, COMBINATIONS)):
            _need(set(names) <= set(known), f"unknown method in {names}")


@dataclass(frozen=True)
class Config:
    general: General = field(default_factory=General)
    data_gen: DataGeneration = field(default_factory=DataGeneration)
    cleaning: Cleaning = field(default_factory=Cleaning)
    anomaly: Anomalies = field(default_factory=Anomalies)
    optimization: Optimization = field(default_factory=Optimization)
    scoring: Scoring = field(default_factory=Scoring)

    def __post_init__(self) -> None:
        for section in fields(self):
            getattr(self, section.name).check()

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def load(values: Mapping[str, Mapping] | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """Defaults, overridden by ``values`` and then by the environment; unknown names are refused."""
    config = Config()
    merged: dict[str, dict] = {s: dict(v) for s, v in (values or {}).items()}
    for name, text in (os.environ if environ is None else environ).items():
        parts = name.lower().split("__")
        if len(parts) == 3 and parts[0] == "tsquorum":
            try:
                value = json.loads(text)
            except json.JSONDecodeError:
                value = text
            merged.setdefault(parts[1], {})[parts[2]] = value
    for section, new in merged.items():
        _need(hasattr(config, section), f"no section {section!r}")
        old = getattr(config, section)
        unknown = set(new) - {f.name for f in fields(old)}
        _need(not unknown, f"no such keys in {section}: {sorted(unknown)}")
        config = replace(config, **{section: replace(old, **{k: tuple(v) if isinstance(v, list) else v for k, v in new.items()})})
    return config
